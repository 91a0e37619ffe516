"""Declared schemas, enums and constants. Every reader takes its schema from here."""

from pyspark.sql import types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(*fields):
    """Build a StructType from (name, type) or (name, type, nullable) tuples."""
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


WEBHOOK_RECEIVED = _struct(
    ("stripe_event_id", _S), ("event_type", _S), ("payload", _S), ("received_at", _TS)
)

VALIDATED_EVENT = _struct(
    ("event_id", _S), ("event_type", _S), ("amount_cents", _L), ("currency", _S),
    ("stripe_customer_id", _S), ("merchant_id", _S), ("received_at", _TS),
)

DLQ = _struct(
    ("event_id", _S), ("original_topic", _S), ("original_offset", _L), ("failure_reason", _S),
    ("retry_count", T.IntegerType()), ("first_failure_ts", _TS), ("payload", _S), ("error_detail", _S),
)

STATE_LOG = _struct(
    ("id", _L), ("transaction_id", _S), ("from_state", _S), ("to_state", _S),
    ("event_id", _S), ("merchant_id", _S), ("created_at", _TS),
)

REVIEW_QUEUE = _struct(
    ("transaction_id", _S), ("risk_score", _D), ("payload", _S), ("created_at", _TS), ("status", _S)
)

LEDGER_ENTRIES = _struct(
    ("id", _L), ("transaction_id", _S), ("amount_cents", _L), ("entry_type", _S),
    ("merchant_id", _S), ("currency", _S), ("source_event_id", _S), ("created_at", _TS),
)

PROCESSOR_INTENTS = _struct(
    ("id", _S), ("amount", _L), ("currency", _S), ("status", _S), ("merchant_id", _S), ("created", _TS)
)

DISCREPANCIES = _struct(
    ("transaction_id", _S), ("discrepancy_type", _S), ("stripe_payment_intent_id", _S),
    ("internal_amount_cents", _L), ("stripe_amount_cents", _L), ("diff_cents", _L),
    ("currency", _S), ("merchant_id", _S), ("stripe_created_at", _TS), ("run_date", T.DateType()),
)

MERCHANT_RISK = _struct(("merchant_id", _S), ("score", _D))

IMBALANCE_SEED = _struct(
    ("transaction_id", _S), ("debit_amount_cents", _L), ("credit_amount_cents", _L)
)

# Event types, states, edges, enums, thresholds and defaults of the data contract.
SUCCEEDED = "payment_intent.succeeded"
SUPPORTED_EVENT_TYPES = [SUCCEEDED, "payment_intent.payment_failed", "payment_intent.canceled"]

INITIATED, VALIDATED, FAILED, SCORING = "INITIATED", "VALIDATED", "FAILED", "SCORING"
AUTHORIZED, FLAGGED, SETTLED, MANUAL_REVIEW = "AUTHORIZED", "FLAGGED", "SETTLED", "MANUAL_REVIEW"
STATES = [INITIATED, VALIDATED, FAILED, SCORING, AUTHORIZED, FLAGGED, SETTLED, MANUAL_REVIEW]
ALLOWED_EDGES = [
    (None, INITIATED), (INITIATED, VALIDATED), (INITIATED, FAILED), (VALIDATED, SCORING),
    (SCORING, AUTHORIZED), (SCORING, FLAGGED), (AUTHORIZED, SETTLED), (FLAGGED, MANUAL_REVIEW),
]

ENTRY_TYPES = ["DEBIT", "CREDIT"]
DISCREPANCY_TYPES = ["MISSING_INTERNALLY", "AMOUNT_MISMATCH", "DUPLICATE_LEDGER"]
SCHEMA_INVALID, LEDGER_WRITE_FAIL = "SCHEMA_INVALID", "LEDGER_WRITE_FAIL"

TOPIC_RECEIVED = "payment.webhook.received"
TOPIC_VALIDATED = "payment.transaction.validated"
TOPIC_SCORED = "payment.transaction.scored"
TOPIC_ALERT = "payment.alert.triggered"
TOPIC_LEDGER = "payment.ledger.entry"
TOPIC_RECONCILIATION = "payment.reconciliation.queue"
TOPIC_DLQ = "payment.dlq"

FEATURE_ORDER = [
    "tx_velocity_1m", "tx_velocity_5m", "amount_zscore", "merchant_risk_score",
    "device_switch_flag", "hour_of_day", "weekend_flag", "amount_cents_log",
]
FEATURE_DEFAULTS = {
    "tx_velocity_1m": 10.0, "tx_velocity_5m": 50.0, "amount_zscore": 2.0, "merchant_risk_score": 1.0,
    "device_switch_flag": 1.0, "hour_of_day": 12.0, "weekend_flag": 0.0, "amount_cents_log": 0.0,
}
DEFAULT_MERCHANT_RISK = 0.5
HIGH_RISK, REVIEW_RISK = 0.7, 0.85
DEVICE_TTL_SECONDS, FEATURE_TTL_SECONDS, VELOCITY_TTL_SECONDS = 300, 3600, 300
SCORED_TTL_SECONDS = 7 * 86_400
RATE_LIMIT_PER_MINUTE = 100
DEFAULT_MERCHANT = "unknown_merchant"
