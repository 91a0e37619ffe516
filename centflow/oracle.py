"""The SQL twin of each query, written independently of the Spark operators.

``{name}`` stands for a derived table of ``sources/testviews.py``; the texts are expanded with these
tables as common table expressions and need only the raw tables.
"""

from centflow.sources.testviews import with_views

_LATEST = """
SELECT transaction_id, merchant_id, to_state AS current_state, from_state AS previous_state, event_id,
  created_at AS state_updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY created_at DESC, id DESC) AS rn
      FROM {payment_state_log}) q WHERE rn = 1"""

_STG = f"""
SELECT l.*, d.amount_cents, d.currency, d.created_at AS settled_at
FROM ({_LATEST}) l
LEFT JOIN (SELECT * FROM {{ledger_entries}} WHERE entry_type = 'DEBIT') d ON l.transaction_id = d.transaction_id"""

_FACT = f"""
SELECT t.* FROM ({_STG}) t
JOIN (SELECT DISTINCT merchant_id FROM {{ledger_entries}} WHERE merchant_id IS NOT NULL) m ON t.merchant_id = m.merchant_id"""


def _balanced(table: str) -> str:
    return f"""
SELECT transaction_id, merchant_id, currency,
  max(CASE WHEN entry_type = 'DEBIT' THEN amount_cents END) AS debit_amount_cents,
  max(CASE WHEN entry_type = 'CREDIT' THEN amount_cents END) AS credit_amount_cents,
  min(created_at) AS settled_at
FROM {{{table}}} GROUP BY transaction_id, merchant_id, currency"""


_BALANCED = _balanced("ledger_entries")


def _fraud(source: str, merchants: str = "merchant_id") -> str:
    return f"""
SELECT date_trunc('day', state_updated_at)::TIMESTAMP AS metric_date, current_state, count(*) AS transaction_count,
  count(DISTINCT {merchants}) AS unique_merchants, sum(coalesce(amount_cents, 0))::BIGINT AS total_amount_cents,
  round(avg(coalesce(amount_cents, 0)), 6) AS avg_amount_cents
FROM ({source}) f GROUP BY 1, 2"""


def _volume(source: str) -> str:
    return f"""
SELECT date_trunc('hour', settled_at)::TIMESTAMP AS payment_hour, count(*) AS settled_count,
  sum(amount_cents)::BIGINT AS total_amount_cents, round(avg(amount_cents), 6) AS avg_amount_cents,
  min(amount_cents) AS min_amount_cents, max(amount_cents) AS max_amount_cents
FROM ({source}) f WHERE current_state = 'SETTLED' AND settled_at IS NOT NULL GROUP BY 1"""


def _merchants(source: str, amount: str) -> str:
    return f"""
SELECT merchant_id, count(DISTINCT transaction_id) AS total_transactions,
  count(DISTINCT CASE WHEN current_state = 'SETTLED' THEN transaction_id END) AS settled_transactions,
  count(DISTINCT CASE WHEN current_state = 'FLAGGED' THEN transaction_id END) AS flagged_transactions,
  sum(coalesce({amount}, 0))::BIGINT AS total_settled_amount_cents,
  round(avg(coalesce({amount}, 0)), 6) AS avg_transaction_amount_cents,
  sum(CASE WHEN debit_amount_cents <> credit_amount_cents THEN 1 ELSE 0 END)::BIGINT AS imbalanced_transactions
FROM ({source}) f GROUP BY merchant_id"""


_DASH_MERCHANT = _merchants(f"""
SELECT l.*, b.debit_amount_cents, b.credit_amount_cents FROM ({_LATEST}) l LEFT JOIN (
  SELECT transaction_id, max(CASE WHEN entry_type = 'DEBIT' THEN amount_cents END) AS debit_amount_cents,
    max(CASE WHEN entry_type = 'CREDIT' THEN amount_cents END) AS credit_amount_cents
  FROM {{ledger_entries}} GROUP BY transaction_id) b ON l.transaction_id = b.transaction_id""", "debit_amount_cents")

_OUTCOME = """
SELECT p.*, d.amount_cents AS l_amount, d.merchant_id AS l_merchant, d.currency AS l_currency, CAST(p.created AS DATE) AS run_date,
  CASE WHEN d.transaction_id IS NULL THEN 'MISSING_INTERNALLY' WHEN p.amount <> d.amount_cents THEN 'AMOUNT_MISMATCH'
    ELSE 'CLEAN' END AS outcome
FROM (SELECT * FROM {processor_intents} WHERE status = 'succeeded') p
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id, CAST(created_at AS DATE) ORDER BY id DESC) AS rn
                          FROM {ledger_entries} WHERE entry_type = 'DEBIT') q WHERE rn = 1) d
  ON p.id = d.transaction_id AND CAST(p.created AS DATE) = CAST(d.created_at AS DATE)"""

_COMPARE = f"""
SELECT id AS transaction_id, outcome AS discrepancy_type, id AS stripe_payment_intent_id,
  CASE WHEN outcome = 'AMOUNT_MISMATCH' THEN l_amount END AS internal_amount_cents,
  CASE WHEN outcome = 'MISSING_INTERNALLY' THEN amount END AS stripe_amount_cents,
  CASE WHEN outcome = 'AMOUNT_MISMATCH' THEN amount - l_amount END AS diff_cents,
  CASE WHEN outcome = 'MISSING_INTERNALLY' THEN upper(currency) ELSE l_currency END AS currency,
  CASE WHEN outcome = 'MISSING_INTERNALLY' THEN coalesce(merchant_id, 'unknown') ELSE l_merchant END AS merchant_id,
  CASE WHEN outcome = 'MISSING_INTERNALLY' THEN created END AS stripe_created_at, run_date
FROM ({_OUTCOME}) o WHERE outcome <> 'CLEAN'"""

_DUPLICATES = """
SELECT transaction_id, 'DUPLICATE_LEDGER' AS discrepancy_type, CAST(NULL AS VARCHAR) AS stripe_payment_intent_id,
  CAST(NULL AS BIGINT) AS internal_amount_cents, CAST(NULL AS BIGINT) AS stripe_amount_cents,
  CAST(NULL AS BIGINT) AS diff_cents, 'USD' AS currency, coalesce(min(merchant_id), 'unknown') AS merchant_id,
  CAST(NULL AS TIMESTAMP) AS stripe_created_at, CAST(created_at AS DATE) AS run_date
FROM {ledger_entries} GROUP BY transaction_id, CAST(created_at AS DATE) HAVING count(*) > 2"""

_ALL = f"SELECT * FROM ({_COMPARE}) a UNION ALL SELECT * FROM ({_DUPLICATES}) b"

_DISCREPANCIES = f"""
SELECT *, concat(transaction_id, '|', discrepancy_type, '|', CAST(run_date AS VARCHAR)) AS id,
  CAST(run_date AS TIMESTAMP) AS created_at FROM ({_ALL}) x"""

_SUMMARY = f"""
SELECT run_date, discrepancy_type, count(*) AS discrepancy_count, count(DISTINCT transaction_id) AS affected_transactions,
  count(DISTINCT merchant_id) AS affected_merchants, sum(coalesce(diff_cents, 0))::BIGINT AS total_diff_cents,
  min(created_at) AS first_seen_at, max(created_at) AS last_seen_at
FROM ({_DISCREPANCIES}) y GROUP BY run_date, discrepancy_type"""

_HISTORY = """
SELECT s.transaction_id, s.merchant_id, s.event_id, s.created_at, d.amount_cents, d.created_at AS settled_at
FROM {payment_state_log} s JOIN {ledger_entries} d ON s.transaction_id = d.transaction_id AND d.entry_type = 'DEBIT'
WHERE s.from_state IS NULL AND s.to_state = 'INITIATED'"""
_RANGE = " AND s.created_at >= TIMESTAMP '1996-01-01' AND s.created_at <= TIMESTAMP '1999-06-30'"


def _reconstructed(history: str) -> str:
    return f"""
SELECT h.transaction_id, h.merchant_id, h.event_id, h.settled_at,
  CAST(count(*) OVER (PARTITION BY h.merchant_id ORDER BY h.created_at RANGE BETWEEN INTERVAL '1' MINUTE PRECEDING AND CURRENT ROW) AS DOUBLE) AS tx_velocity_1m,
  CAST(count(*) OVER (PARTITION BY h.merchant_id ORDER BY h.created_at RANGE BETWEEN INTERVAL '5' MINUTE PRECEDING AND CURRENT ROW) AS DOUBLE) AS tx_velocity_5m,
  round(CASE WHEN coalesce(stddev_samp(h.amount_cents) OVER m, 0) = 0 THEN 0
    ELSE (h.amount_cents - avg(h.amount_cents) OVER m) / stddev_samp(h.amount_cents) OVER m END, 6) AS amount_zscore,
  coalesce(r.score, 0.5) AS merchant_risk_score, CAST(0 AS DOUBLE) AS device_switch_flag,
  CAST(extract(hour FROM h.created_at) AS DOUBLE) AS hour_of_day,
  CASE WHEN dayofweek(h.created_at) IN (0, 6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weekend_flag,
  round(ln(1 + h.amount_cents), 6) AS amount_cents_log
FROM ({history}) h LEFT JOIN {{merchant_risk}} r ON h.merchant_id = r.merchant_id
WINDOW m AS (PARTITION BY h.merchant_id)"""


def _velocity(**sizes: str) -> str:
    counts = ", ".join(
        f"count(*) OVER (PARTITION BY merchant_id ORDER BY received_at RANGE BETWEEN INTERVAL {size} PRECEDING AND CURRENT ROW) AS {name}"
        for name, size in sizes.items()
    )
    return f"SELECT event_id, {counts} FROM {{payment_events}}"


_RUNNING_Z = """
SELECT event_id, CASE WHEN n < 3 THEN 0.0 WHEN coalesce(s, 0) <= 0 THEN amount_cents - a ELSE (amount_cents - a) / s END AS z
FROM (SELECT event_id, amount_cents, count(*) OVER w AS n, avg(amount_cents) OVER w AS a, stddev_samp(amount_cents) OVER w AS s
      FROM {payment_events}
      WINDOW w AS (PARTITION BY merchant_id ORDER BY received_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) q"""

_DEVICE = """
SELECT event_id, CAST(CASE WHEN stripe_customer_id <> '' AND last_merchant <> merchant_id
  AND received_at <= last_at + INTERVAL '300' SECOND THEN 1 ELSE 0 END AS INTEGER) AS device_switch_flag
FROM (SELECT *, lag(merchant_id) OVER w AS last_merchant, lag(received_at) OVER w AS last_at FROM {payment_events}
      WINDOW w AS (PARTITION BY stripe_customer_id ORDER BY received_at, event_id)) q"""


def _rate_limit(limit: int, bucket: str, columns: str = "event_id, merchant_id, received_at, position, limited") -> str:
    return f"""
SELECT {columns} FROM (
  SELECT *, CASE WHEN event_type = 'payment_intent.succeeded' THEN n END AS position,
    coalesce(CASE WHEN event_type = 'payment_intent.succeeded' THEN n > {limit} END, FALSE) AS limited
  FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id, date_trunc('{bucket}', received_at), event_type = 'payment_intent.succeeded'
                                     ORDER BY received_at, event_id) AS n FROM {{payment_events}}) q) r"""


def _dedup(ttl: str) -> str:
    return f"""WITH RECURSIVE accepted AS (
  SELECT stripe_event_id, event_type, min(received_at) AS at FROM {{webhook_received}} GROUP BY 1, 2
  UNION ALL
  SELECT a.stripe_event_id, a.event_type, min(w.received_at) AS at
  FROM accepted a JOIN {{webhook_received}} w ON w.stripe_event_id = a.stripe_event_id AND w.event_type = a.event_type
    AND w.received_at >= a.at + INTERVAL {ttl} GROUP BY 1, 2)
SELECT w.stripe_event_id, w.event_type, min(w.seq) AS seq, w.received_at
FROM accepted a JOIN {{webhook_received}} w ON w.stripe_event_id = a.stripe_event_id AND w.event_type = a.event_type AND w.received_at = a.at
GROUP BY w.stripe_event_id, w.event_type, w.received_at"""


_EXTRACT = """
SELECT stripe_event_id, seq, event_type, payload, received_at,
  CASE WHEN json_type(payload, '$.data.object.amount') IN ('BIGINT', 'UBIGINT')
    THEN CAST(json_extract_string(payload, '$.data.object.amount') AS BIGINT) END AS amount_cents,
  CASE WHEN json_type(payload, '$.data.object.currency') IS NULL THEN 'usd'
    ELSE json_extract_string(payload, '$.data.object.currency') END AS currency,
  coalesce(json_extract_string(payload, '$.data.object.customer'), '') AS stripe_customer_id,
  CASE WHEN json_type(payload, '$.data.object.metadata.merchant_id') IS NULL THEN 'unknown_merchant'
    ELSE json_extract_string(payload, '$.data.object.metadata.merchant_id') END AS merchant_id,
  json_type(payload, '$.data.object') AS object_type, json_type(payload, '$.data.object.amount') AS amount_type
FROM {webhook_received}"""

_CHECKED = f"""
SELECT *, CASE WHEN failure_detail IS NOT NULL THEN 'SCHEMA_INVALID' END AS failure_reason FROM (
SELECT *, CASE
  WHEN event_type NOT IN ('payment_intent.succeeded', 'payment_intent.payment_failed', 'payment_intent.canceled') THEN 'event_type'
  WHEN object_type IS NULL THEN 'object_missing'
  WHEN amount_type IS NULL THEN 'amount_missing'
  WHEN amount_cents IS NULL THEN 'amount_not_integer'
  WHEN event_type = 'payment_intent.succeeded' AND amount_cents < 0 THEN 'amount_negative'
  WHEN event_type = 'payment_intent.succeeded' AND amount_cents = 0 THEN 'amount_zero' END AS failure_detail
FROM ({_EXTRACT}) e) c"""

_SCORED = """
SELECT *, risk_score >= 0.7 AS is_high_risk, risk_score >= 0.85 OR NOT features_available AS manual_review FROM {scored_input}"""

_MESSAGE = f"""
SELECT event_id, event_type, amount_cents, currency, merchant_id, event_id AS source_event_id, stripe_customer_id, risk_score
FROM ({_SCORED}) s WHERE risk_score < 0.7"""

_ENRICH = """CAST(extract(hour FROM received_at) AS INTEGER) AS hour_of_day,
  CAST(CASE WHEN dayofweek(received_at) IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS weekend_flag,
  round(ln(1 + amount_cents), 6) AS amount_cents_log"""
_ENRICHED = f"SELECT *, {_ENRICH} FROM {{payment_events}}"

_TUMBLING = """
SELECT date_trunc('minute', received_at)::TIMESTAMP AS window_start, (date_trunc('minute', received_at) + INTERVAL 1 MINUTE)::TIMESTAMP AS window_end,
  merchant_id, count(*) AS "count" FROM {payment_events} GROUP BY 1, 2, 3"""
_SLIDING = """
SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, merchant_id, count(*) AS "count" FROM (
  SELECT date_trunc('minute', received_at)::TIMESTAMP - k * INTERVAL 1 MINUTE AS window_start, merchant_id
  FROM {payment_events}, (VALUES (0), (1), (2), (3), (4)) AS s(k)) q GROUP BY 1, 3"""


_LIVE = f"""
SELECT p.event_id, p.merchant_id, CAST(v.tx_velocity_1m AS DOUBLE) AS tx_velocity_1m, CAST(v.tx_velocity_5m AS DOUBLE) AS tx_velocity_5m,
  round(z.z, 4) AS amount_zscore, coalesce(r.score, 0.5) AS merchant_risk_score, CAST(d.device_switch_flag AS DOUBLE) AS device_switch_flag,
  CAST(p.hour_of_day AS DOUBLE) AS hour_of_day, CAST(p.weekend_flag AS DOUBLE) AS weekend_flag, p.amount_cents_log
FROM ({_ENRICHED}) p JOIN ({_velocity(tx_velocity_1m="'1' MINUTE", tx_velocity_5m="'5' MINUTE")}) v ON v.event_id = p.event_id
JOIN ({_RUNNING_Z}) z ON z.event_id = p.event_id JOIN ({_DEVICE}) d ON d.event_id = p.event_id
LEFT JOIN {{merchant_risk}} r ON r.merchant_id = p.merchant_id"""


def _error_rate(trunc: str, threshold: float) -> str:
    return f"""
SELECT {trunc} AS window_start, count(*) AS requests, round(avg(CASE WHEN is_error THEN 1 ELSE 0 END), 6) AS error_rate,
  avg(CASE WHEN is_error THEN 1 ELSE 0 END) > {threshold} AS breach FROM {{request_log}} GROUP BY 1"""


def _quantiles(trunc: str) -> str:
    return f"""
SELECT {trunc} AS window_start, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.99), 6) AS p99,
  quantile_cont(latency, 0.99) > 0.2 AS breach FROM {{request_log}} GROUP BY 1"""


_FIVE = "time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01')"
_STEPS = """(VALUES (1, NULL, 'INITIATED', 'FAILED'), (2, 'INITIATED', 'FAILED', 'FAILED'),
  (1, NULL, 'INITIATED', 'OK'), (2, 'INITIATED', 'VALIDATED', 'OK'), (3, 'VALIDATED', 'SCORING', 'OK'),
  (4, 'SCORING', 'FLAGGED', 'FLAGGED'), (4, 'SCORING', 'AUTHORIZED', 'AUTHORIZED'), (4, 'SCORING', 'AUTHORIZED', 'SETTLED'),
  (5, 'AUTHORIZED', 'SETTLED', 'SETTLED')) AS t(seq, from_state, to_state, path)"""

_DQ = {
    "payment_state_log": "{payment_state_log}", "ledger_entries": "{ledger_tampered}",
    "reconciliation_discrepancies": f"({_DISCREPANCIES})", "stg_transactions": f"({_STG})",
    "stg_ledger_entries": "{ledger_tampered}",
    "dim_merchants": "(SELECT DISTINCT merchant_id FROM {ledger_tampered} WHERE merchant_id IS NOT NULL)",
    "dim_users": "(SELECT DISTINCT event_id FROM {payment_state_log} WHERE event_id IS NOT NULL)",
    "fact_ledger_balanced": f"({_balanced('ledger_tampered')})",
}
_DQ_COLUMNS = [
    ("payment_state_log", "transaction_id"), ("payment_state_log", "to_state"), ("payment_state_log", "merchant_id"),
    ("ledger_entries", "transaction_id"), ("ledger_entries", "entry_type"), ("ledger_entries", "amount_cents"),
    ("ledger_entries", "merchant_id"), ("reconciliation_discrepancies", "id"),
    ("reconciliation_discrepancies", "transaction_id"), ("reconciliation_discrepancies", "discrepancy_type"),
    ("reconciliation_discrepancies", "merchant_id"), ("stg_transactions", "transaction_id"),
    ("stg_ledger_entries", "transaction_id"), ("stg_ledger_entries", "entry_type"), ("dim_merchants", "merchant_id"),
    ("dim_users", "event_id"), ("fact_ledger_balanced", "transaction_id"),
    ("fact_ledger_balanced", "debit_amount_cents"), ("fact_ledger_balanced", "credit_amount_cents"),
]
_DQ_NOT_NULL = " UNION ALL ".join(
    [f"SELECT 'stg_transactions_amount' AS table_name, 'amount_cents' AS column_name, count(*) - count(amount_cents) AS failures FROM ({_STG}) x"]
    + [f"SELECT '{t}', '{c}', count(*) - count({c}) FROM {_DQ[t]} x" for t, c in _DQ_COLUMNS]
)
_DQ_UNIQUE = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS failures FROM (SELECT {c} FROM {_DQ[t]} x GROUP BY {c} HAVING count(*) > 1) y"
    for t, c in [("stg_transactions", "transaction_id"), ("dim_merchants", "merchant_id"), ("dim_users", "event_id"),
                 ("fact_ledger_balanced", "transaction_id"), ("reconciliation_discrepancies", "id")]
)
_DQ_ACCEPTED = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS failures FROM {_DQ[t]} x WHERE {c} NOT IN ({values})"
    for t, c, values in [
        ("ledger_entries", "entry_type", "'DEBIT', 'CREDIT'"), ("stg_ledger_entries", "entry_type", "'DEBIT', 'CREDIT'"),
        ("reconciliation_discrepancies", "discrepancy_type", "'MISSING_INTERNALLY', 'AMOUNT_MISMATCH', 'DUPLICATE_LEDGER'")]
)
_MODELS = {
    "stg_transactions": _STG, "stg_ledger_entries": "SELECT * FROM {ledger_entries}",
    "dim_merchants": "SELECT DISTINCT merchant_id FROM {ledger_entries}",
    "dim_users": "SELECT DISTINCT event_id FROM {payment_state_log}", "fact_transactions": _FACT,
    "fact_ledger_balanced": _BALANCED, "fraud_metrics": _fraud(_FACT), "hourly_payment_volume": _volume(_FACT),
    "merchant_performance": "SELECT DISTINCT merchant_id FROM (" + _FACT + ") f", "reconciliation_summary": _SUMMARY,
}

_FEATURES = ", ".join(("tx_velocity_1m tx_velocity_5m amount_zscore merchant_risk_score device_switch_flag hour_of_day weekend_flag "
                       "amount_cents_log").split())


_LIFECYCLE = f"""WITH once AS (SELECT *, failure_reason IS NULL AS valid, amount_cents % 100 >= 70 AS risky FROM ({_CHECKED}) c WHERE seq = 0),
rows_of AS (
  SELECT 'payment_state_log' AS table_name, 'INITIATED' AS kind FROM once
  UNION ALL SELECT 'payment_state_log', CASE WHEN valid THEN 'VALIDATED' ELSE 'FAILED' END FROM once
  UNION ALL SELECT 'payment_state_log', 'SCORING' FROM once WHERE valid
  UNION ALL SELECT 'payment_state_log', CASE WHEN risky THEN 'FLAGGED' ELSE 'AUTHORIZED' END FROM once WHERE valid
  UNION ALL SELECT 'payment_state_log', 'SETTLED' FROM once WHERE valid AND NOT risky AND amount_cents > 0
  UNION ALL SELECT 'ledger_entries', e.kind FROM once, (VALUES ('DEBIT'), ('CREDIT')) AS e(kind) WHERE valid AND NOT risky AND amount_cents > 0
  UNION ALL SELECT 'dlq', 'SCHEMA_INVALID' FROM once WHERE NOT valid
  UNION ALL SELECT 'dlq', 'LEDGER_WRITE_FAIL' FROM once WHERE valid AND NOT risky AND amount_cents <= 0
  UNION ALL SELECT 'manual_review_queue', 'PENDING' FROM once WHERE valid AND risky
  UNION ALL SELECT 'alerts', 'payment.alert.triggered' FROM once WHERE valid AND risky)
SELECT table_name, kind, count(*) AS row_count FROM rows_of GROUP BY 1, 2"""


_PERFORMANCE = _merchants(
    f"SELECT f.*, b.debit_amount_cents, b.credit_amount_cents FROM ({_FACT}) f LEFT JOIN ({_BALANCED}) b ON f.transaction_id = b.transaction_id", "amount_cents")

_SQL = {
    "stream_source": "SELECT * FROM {payment_events}",
    "state_log_scan": "SELECT * FROM {payment_state_log} WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1999-06-30'",
    "feature_store_write": _reconstructed(_HISTORY),
    "velocity_upsert": """SELECT merchant_id, CAST(floor(epoch(received_at) / 60) AS BIGINT) AS epoch_minute, count(*) AS "count"
FROM {payment_events} GROUP BY 1, 2""",
    "feature_upsert": f"SELECT event_id, {_FEATURES} FROM ({_LIVE}) l",
    "feature_service": f"""
SELECT 'features' AS store, count(*) AS entries, sum(tx_velocity_5m) AS total FROM ({_LIVE}) l
UNION ALL SELECT 'velocity_1m', count(*), sum(count)::DOUBLE FROM ({_TUMBLING}) t
UNION ALL SELECT 'velocity_5m', count(*), sum(count)::DOUBLE FROM ({_SLIDING}) s""",
    "csv_seed": "SELECT event_id, merchant_id, amount_cents FROM {payment_events}",
    "webhook_envelope": """
SELECT event_id AS stripe_event_id, event_type, received_at,
  length(concat('{{"id":"', event_id, '","type":"', event_type, '","amount_cents":', amount_cents, '}}'))::INTEGER AS payload_chars
FROM {payment_events}""",
    "train_risk_model": """
SELECT event_id, CASE WHEN substr(md5(concat('42:', event_id)), 1, 2) < 'cd' THEN 'training' ELSE 'held out' END AS part FROM {payment_events}""",
    "score_auc": """
WITH s AS (SELECT amount_cents % 100 AS score, (event_type = 'payment_intent.payment_failed')::INT AS label FROM {payment_events}),
c AS (SELECT score, sum(label) AS ones, sum(1 - label) AS zeros FROM s GROUP BY score),
r AS (SELECT *, sum(zeros) OVER (ORDER BY score) AS upto FROM c)
SELECT round(sum(ones * (upto - zeros / 2)) / (sum(ones) * sum(zeros)), 6) AS auc FROM r""",
    "topic_payload": f"""
SELECT 'payment.ledger.entry' AS topic, event_id AS "key", concat('{{{{"event_id":"', event_id, '","event_type":"', event_type,
  '","amount_cents":', CAST(amount_cents AS VARCHAR), ',"currency":"', currency, '","merchant_id":"', merchant_id, '","source_event_id":"',
  source_event_id, '","stripe_customer_id":"', stripe_customer_id, '","risk_score":', CAST(risk_score AS VARCHAR), '}}}}') AS "value"
FROM ({_MESSAGE}) m""",
    "publish_batch": f"""
SELECT 'payment.reconciliation.queue' AS topic, transaction_id AS "key", concat('{{{{"transaction_id":"', transaction_id, '","discrepancy_type":"', discrepancy_type,
  '","stripe_payment_intent_id":', coalesce('"' || stripe_payment_intent_id || '"', 'null'),
  ',"internal_amount_cents":', coalesce(CAST(internal_amount_cents AS VARCHAR), 'null'), ',"stripe_amount_cents":', coalesce(CAST(stripe_amount_cents AS VARCHAR), 'null'),
  ',"diff_cents":', coalesce(CAST(diff_cents AS VARCHAR), 'null'), ',"currency":"', currency, '","merchant_id":"', merchant_id,
  '","stripe_created_at":', coalesce(strftime(stripe_created_at, '"%Y-%m-%dT%H:%M:%S.%fZ"'), 'null'),
  ',"run_date":"', CAST(run_date AS VARCHAR), '"}}}}') AS "value" FROM ({_ALL}) x""",
    "append_rows": "SELECT * FROM {ledger_entries}",
    "append_history": """SELECT year(created_at)::INTEGER AS year, count(*) AS row_count, sum(amount_cents)::BIGINT AS amount_cents
FROM {ledger_entries} GROUP BY 1""",
    "warehouse_export": f"SELECT transaction_id, discrepancy_type, diff_cents, merchant_id, run_date FROM ({_ALL}) x WHERE run_date = DATE '1997-02-13'",
    "processor_window": """SELECT id, amount, currency, created, merchant_id FROM {processor_intents}
WHERE status = 'succeeded' AND created >= TIMESTAMP '1997-02-13 00:00:00' AND created <= TIMESTAMP '1997-02-13 23:59:59.999999'""",
    "marts_incremental": _PERFORMANCE,
    "materialize": " UNION ALL ".join(f"SELECT '{n}' AS model, count(*) AS row_count FROM ({q}) x" for n, q in _MODELS.items()),
    "extract_nested": f"SELECT stripe_event_id, seq, amount_cents, currency, stripe_customer_id, merchant_id FROM ({_EXTRACT}) e",
    "validate_events": f"SELECT stripe_event_id, seq, failure_reason, failure_detail FROM ({_CHECKED}) c",
    "valid_events": f"SELECT stripe_event_id AS event_id, event_type, amount_cents, currency, stripe_customer_id, merchant_id, received_at FROM ({_CHECKED}) c WHERE failure_reason IS NULL",
    "dlq_split": f"""
SELECT stripe_event_id AS event_id, 'payment.webhook.received' AS original_topic, failure_reason, CAST(0 AS INTEGER) AS retry_count,
  received_at AS first_failure_ts, payload, failure_detail AS error_detail FROM ({_CHECKED}) c WHERE failure_reason IS NOT NULL""",
    "ledger_validate": """
SELECT k, amount_cents, merchant_id, CASE WHEN NOT ok THEN 'unknown' ELSE coalesce(event, 'unknown') END AS event_id, currency, source_event_id, failure_detail,
  CASE WHEN failure_detail IS NOT NULL THEN 'LEDGER_WRITE_FAIL' END AS failure_reason FROM (
SELECT *, CASE WHEN NOT ok THEN 'malformed_json' WHEN amount_cents IS NULL THEN 'amount_not_integer' WHEN coalesce(event, '') = '' THEN 'event_id_empty'
    WHEN coalesce(merchant_id, '') = '' THEN 'merchant_id_empty' WHEN amount_cents <= 0 THEN 'amount_not_positive' END AS failure_detail FROM (
SELECT k, json_valid(payload) AS ok,
  CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.event_id') END AS event,
  CASE WHEN json_valid(payload) AND json_type(payload, '$.amount_cents') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(payload, '$.amount_cents') AS BIGINT) END AS amount_cents,
  CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.merchant_id') END AS merchant_id,
  CASE WHEN json_valid(payload) THEN coalesce(json_extract_string(payload, '$.currency'), 'usd') ELSE 'usd' END AS currency,
  CASE WHEN json_valid(payload) THEN coalesce(json_extract_string(payload, '$.source_event_id'), json_extract_string(payload, '$.event_id')) END AS source_event_id
FROM {ledger_messages}) p) q""",
    "state_transitions": f"""
SELECT event_id AS transaction_id, event_id, merchant_id, from_state, to_state, received_at + seq * INTERVAL 1 MICROSECOND AS created_at
FROM (SELECT *, CASE WHEN event_type LIKE 'charge%' THEN 'FAILED' WHEN risk_score >= 0.7 THEN 'FLAGGED'
        WHEN event_type = 'payment_intent.succeeded' THEN 'SETTLED' ELSE 'AUTHORIZED' END AS outcome FROM ({_SCORED}) s) o
JOIN {_STEPS} ON t.path = o.outcome OR (t.path = 'OK' AND o.outcome <> 'FAILED')""",
    "route_scored": f"""
SELECT 'scored' AS stream, event_id FROM ({_SCORED}) a UNION ALL SELECT 'alert', event_id FROM ({_SCORED}) a WHERE is_high_risk
UNION ALL SELECT 'ledger', event_id FROM ({_SCORED}) a WHERE risk_score < 0.7
UNION ALL SELECT 'review', event_id FROM ({_SCORED}) a WHERE risk_score >= 0.7 AND manual_review
UNION ALL SELECT CASE WHEN risk_score >= 0.7 THEN 'FLAGGED' ELSE 'AUTHORIZED' END, event_id FROM ({_SCORED}) a""",
    "ledger_message": _MESSAGE,
    "double_entry": f"""SELECT event_id AS transaction_id, amount_cents, entry_type, merchant_id, currency, source_event_id
FROM ({_MESSAGE}) m, (VALUES ('DEBIT'), ('CREDIT')) AS e(entry_type)""",
    "stg_ledger_entries": "SELECT id AS ledger_entry_id, transaction_id, amount_cents, entry_type, merchant_id, currency, source_event_id, created_at FROM {ledger_entries}",
    "utc_day_filter": "SELECT * FROM {ledger_entries} WHERE created_at >= TIMESTAMP '1997-02-13 00:00:00' AND created_at <= TIMESTAMP '1997-02-13 23:59:59.999999'",
    "date_range_filter": "SELECT * FROM {ledger_entries} WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1999-06-30'",
    "dashboard_filter": f"SELECT metric_date, current_state, transaction_count, unique_merchants, total_amount_cents FROM ({_fraud(_STG)}) m WHERE current_state = 'FLAGGED'",
    "dashboard_choices": "SELECT DISTINCT merchant_id FROM {payment_state_log}",
    "settled_history": _HISTORY + _RANGE,
    "settled_history_all": _HISTORY,
    "stg_transactions": _STG,
    "fact_transactions": _FACT,
    "recon_compare": _COMPARE,
    "recon_compare_bucketed": _COMPARE,
    "recon_compare_day": f"SELECT * FROM ({_COMPARE}) x WHERE run_date = DATE '1997-02-13'",
    "merchant_risk_lookup": "SELECT p.event_id, p.merchant_id, coalesce(r.score, 0.5) AS merchant_risk_score FROM {payment_events} p LEFT JOIN {merchant_risk} r ON p.merchant_id = r.merchant_id",
    "feature_lookup": """
SELECT p.event_id, coalesce(f.tx_velocity_1m, 10.0) AS tx_velocity_1m, coalesce(f.tx_velocity_5m, 50.0) AS tx_velocity_5m,
  coalesce(f.amount_zscore, 2.0) AS amount_zscore, coalesce(f.merchant_risk_score, 1.0) AS merchant_risk_score,
  coalesce(f.device_switch_flag, 1.0) AS device_switch_flag, CASE WHEN f.event_id IS NULL THEN 12.0::DOUBLE ELSE coalesce(f.hour_of_day, 0.0) END AS hour_of_day,
  coalesce(f.weekend_flag, 0.0) AS weekend_flag, coalesce(f.amount_cents_log, 0.0) AS amount_cents_log, f.event_id IS NOT NULL AS features_available
FROM {payment_events} p LEFT JOIN {stored_features} f ON p.event_id = f.event_id""",
    "stream_feature_lookup": "SELECT event_id, " + ", ".join(
        f"CASE WHEN ok THEN 1.0 ELSE {d}::DOUBLE END AS {c}" for c, d in zip(_FEATURES.split(", "), (10, 50, 2, 1, 1, 12, 0, 0))) + """, ok AS features_available
FROM (SELECT event_id, amount_cents % 3 = 0 AND amount_cents % 40 - 20 <= 10 AS ok FROM {payment_events}) e""",
    "skip_already_scored": "SELECT * FROM {payment_events} p WHERE NOT EXISTS (SELECT 1 FROM {done_states} d WHERE d.event_id = p.event_id AND d.to_state = 'SCORING')",
    "skip_already_settled": "SELECT * FROM {payment_events} p WHERE NOT EXISTS (SELECT 1 FROM {done_states} d WHERE d.event_id = p.event_id AND d.to_state = 'SETTLED')",
    "idempotent_append": """SELECT * FROM {ledger_entries} n WHERE NOT EXISTS (
  SELECT 1 FROM {ledger_loaded} t WHERE t.transaction_id = n.transaction_id AND t.entry_type = n.entry_type)""",
    "fraud_metrics": _fraud(_FACT),
    "hourly_payment_volume": _volume(_FACT),
    "merchant_performance": _PERFORMANCE,
    "reconciliation_summary": _SUMMARY,
    "fact_ledger_balanced": _BALANCED,
    "recon_duplicates": _DUPLICATES,
    "ledger_balance": """SELECT transaction_id, sum(CASE entry_type WHEN 'CREDIT' THEN amount_cents WHEN 'DEBIT' THEN -amount_cents ELSE 0 END)::BIGINT AS balance_cents
FROM {ledger_entries} GROUP BY transaction_id HAVING balance_cents <> 0""",
    "dim_merchants": "SELECT DISTINCT merchant_id FROM {ledger_entries} WHERE merchant_id IS NOT NULL",
    "dim_users": "SELECT DISTINCT event_id FROM {payment_state_log} WHERE event_id IS NOT NULL",
    "dash_fraud_metrics": _fraud(_STG),
    "dash_payment_volume": _volume(_STG),
    "dash_merchant_performance": _DASH_MERCHANT,
    "dash_reconciliation": _SUMMARY,
    "kpi_fraud": f"""SELECT sum(transaction_count)::BIGINT AS total_transactions, max(unique_merchants) AS unique_merchants,
  sum(CASE WHEN current_state = 'FLAGGED' THEN transaction_count ELSE 0 END)::BIGINT AS flagged_transactions FROM ({_fraud(_STG)}) m""",
    "kpi_volume": f"""SELECT sum(settled_count)::BIGINT AS total_settled, round(sum(total_amount_cents) / 100, 4) AS total_volume_usd,
  round(avg(total_amount_cents / settled_count) / 100, 4) AS avg_transaction_usd FROM ({_volume(_STG)}) m""",
    "kpi_merchant": f"""SELECT count(*) AS total_merchants, round(sum(total_settled_amount_cents) / 100, 4) AS total_settled_usd,
  sum(flagged_transactions)::BIGINT AS total_flagged FROM ({_DASH_MERCHANT}) m""",
    "kpi_recon": f"""SELECT sum(discrepancy_count)::BIGINT AS total_discrepancies, sum(affected_transactions)::BIGINT AS affected_transactions,
  round(sum(total_diff_cents) / 100, 4) AS total_diff_usd FROM ({_SUMMARY}) m""",
    "state_pivot": f"""SELECT metric_date, sum(CASE WHEN current_state = 'AUTHORIZED' THEN transaction_count ELSE 0 END)::BIGINT AS "AUTHORIZED",
  sum(CASE WHEN current_state = 'FLAGGED' THEN transaction_count ELSE 0 END)::BIGINT AS "FLAGGED",
  sum(CASE WHEN current_state = 'SETTLED' THEN transaction_count ELSE 0 END)::BIGINT AS "SETTLED" FROM ({_fraud(_STG)}) m GROUP BY metric_date""",
    "discrepancy_by_type": f"SELECT discrepancy_type, count(*) AS discrepancy_count FROM ({_ALL}) x GROUP BY discrepancy_type",
    "volume_series": f"SELECT payment_hour, total_amount_cents FROM ({_volume(_STG)}) m",
    "merchant_series": f"SELECT merchant_id, total_settled_amount_cents FROM ({_DASH_MERCHANT}) m",
    "recon_run_counts": f"""SELECT run_date, count(*) FILTER (WHERE outcome = 'MISSING_INTERNALLY') AS missing_count,
  count(*) FILTER (WHERE outcome = 'AMOUNT_MISMATCH') AS mismatch_count, count(*) FILTER (WHERE outcome = 'CLEAN') AS clean_count FROM ({_OUTCOME}) o GROUP BY run_date""",
    "stage_counters": f"""SELECT count(*) AS scored, count(*) FILTER (WHERE is_high_risk) AS flagged, count(*) FILTER (WHERE risk_score < 0.7) AS ledger_published,
  count(*) FILTER (WHERE risk_score >= 0.7 AND manual_review) AS review_queued, count(*) FILTER (WHERE NOT features_available) AS feature_misses,
  (SELECT count(*) FROM ({_CHECKED}) c WHERE failure_reason IS NOT NULL) AS dead_letters,
  count(*) FILTER (WHERE risk_score < 0.7 AND amount_cents > 0 AND coalesce(event_id, '') <> '' AND coalesce(merchant_id, '') <> '') AS settled FROM ({_SCORED}) s""",
    "stream_stage_counters": f"""
SELECT count(*) FILTER (WHERE valid) AS scored, count(*) FILTER (WHERE valid AND risky) AS flagged, count(*) FILTER (WHERE valid AND NOT risky) AS ledger_published,
  count(*) FILTER (WHERE valid AND risky) AS review_queued, count(*) FILTER (WHERE valid) AS feature_misses,
  count(*) FILTER (WHERE NOT valid OR (NOT risky AND amount_cents <= 0)) AS dead_letters, count(*) FILTER (WHERE valid AND NOT risky AND amount_cents > 0) AS settled
FROM (SELECT *, failure_reason IS NULL AS valid, amount_cents % 100 >= 70 AS risky FROM ({_CHECKED}) c WHERE seq = 0) o""",
    "recon_all": _ALL,
    "latest_state": _LATEST,
    "tx_velocity_1m": _velocity(tx_velocity_1m="'1' MINUTE"),
    "tx_velocity_5m": _velocity(tx_velocity_5m="'5' MINUTE"),
    "tx_velocity_1h_6h": _velocity(tx_velocity_1h="'1' HOUR", tx_velocity_6h="'6' HOUR"),
    "amount_zscore_running": f"SELECT event_id, round(z, 4) AS amount_zscore FROM ({_RUNNING_Z}) r",
    "amount_zscore_batch": """SELECT event_id, round(CASE WHEN coalesce(stddev_samp(amount_cents) OVER m, 0) = 0 THEN 0
  ELSE (amount_cents - avg(amount_cents) OVER m) / stddev_samp(amount_cents) OVER m END, 6) AS amount_zscore FROM {payment_events} WINDOW m AS (PARTITION BY merchant_id)""",
    "device_switch_flag": _DEVICE,
    "merchant_rate_limit": _rate_limit(100, "minute"),
    "merchant_rate_limit_1h": _rate_limit(1, "hour"),
    "merchant_rate_limit_2d": _rate_limit(2, "day"),
    "ingest_dedup": _dedup("'24' HOUR"),
    "ingest_dedup_30m": _dedup("'30' MINUTE"),
    "ingest_dedup_hot": """WITH RECURSIVE accepted AS (
  SELECT event_type, min(received_at) AS at FROM {webhook_received} GROUP BY 1
  UNION ALL
  SELECT a.event_type, min(w.received_at) AS at
  FROM accepted a JOIN {webhook_received} w ON w.event_type = a.event_type AND w.received_at >= a.at + INTERVAL '3' HOUR GROUP BY 1)
SELECT w.event_type, min(w.seq) AS seq, w.received_at
FROM accepted a JOIN {webhook_received} w ON w.event_type = a.event_type AND w.received_at = a.at GROUP BY w.event_type, w.received_at""",
    "velocity_1m_windows": _TUMBLING,
    "velocity_5m_windows": _SLIDING,
    "stream_velocity_1m": _TUMBLING,
    "stream_velocity_5m": _SLIDING,
    "enriched_events": _ENRICHED,
    "stream_enriched": _ENRICHED,
    "stream_zscore": f"SELECT event_id, round(z, 4) AS amount_zscore FROM ({_RUNNING_Z}) r",
    "stream_zscore_carried": f"SELECT event_id, round(z, 4) AS amount_zscore FROM ({_RUNNING_Z}) r",
    "stream_device_switch": _DEVICE,
    "stream_device_switch_carried": _DEVICE,
    "stream_dedup": "SELECT DISTINCT stripe_event_id, event_type FROM {webhook_received}",
    "stream_dedup_late": "SELECT DISTINCT stripe_event_id, event_type FROM {webhook_received}",
    "stream_rate_limit": _rate_limit(2, "day", "event_id, position, limited"),
    "stream_rate_limit_late": f"""
SELECT merchant_id, date_trunc('day', received_at)::TIMESTAMP AS bucket, count(*) AS events, count(position) AS counted,
  count(*) FILTER (WHERE limited) AS limited_events FROM ({_rate_limit(2, "day")}) x GROUP BY 1, 2""",
    "stream_rate_limit_carried": f"""
SELECT merchant_id, date_trunc('day', received_at)::TIMESTAMP AS bucket, count(*) AS events, count(position) AS counted,
  count(*) FILTER (WHERE limited) AS limited_events FROM ({_rate_limit(2, "day")}) x GROUP BY 1, 2""",
    "stream_lifecycle": _LIFECYCLE,
    "stream_lifecycle_late": _LIFECYCLE,
    "score_fallback": f"SELECT event_id, risk_score, is_high_risk, manual_review FROM ({_SCORED}) s",
    "reconstruct_features": _reconstructed(_HISTORY),
    "reconstruct_features_range": _reconstructed(_HISTORY + _RANGE),
    "risk_score_compiled": "SELECT event_id, TRUE AS equal FROM {payment_events}",
    "feature_vector": f"""
SELECT event_id, tx_velocity_1m AS f0, tx_velocity_5m AS f1, amount_zscore AS f2, round(merchant_risk_score, 4) AS f3, device_switch_flag AS f4,
  hour_of_day AS f5, weekend_flag AS f6, round(ln(1 + amount_cents), 4) AS f7 FROM ({_LIVE}) l JOIN {{payment_events}} e USING (event_id)""",
    "live_features": _LIVE,
    "dq_not_null": _DQ_NOT_NULL,
    "dq_unique": _DQ_UNIQUE,
    "dq_accepted_values": _DQ_ACCEPTED,
    "assert_ledger_balanced": f"SELECT transaction_id, debit_amount_cents, credit_amount_cents, merchant_id FROM ({_BALANCED}) b WHERE debit_amount_cents <> credit_amount_cents",
    "append_only_digests": "SELECT * FROM {ledger_entries} EXCEPT ALL SELECT * FROM {ledger_tampered}",
    "append_only_audit": "SELECT * FROM {ledger_entries} EXCEPT ALL SELECT * FROM {ledger_tampered}",
    "state_machine_audit": """
SELECT * FROM (SELECT id, transaction_id, from_state, to_state, previous_to,
  concat(coalesce(from_state, ''), '>', to_state) NOT IN ('>INITIATED', 'INITIATED>VALIDATED', 'INITIATED>FAILED', 'VALIDATED>SCORING', 'SCORING>AUTHORIZED',
    'SCORING>FLAGGED', 'AUTHORIZED>SETTLED', 'FLAGGED>MANUAL_REVIEW') AND to_state <> 'FAILED' AS bad_edge,
  from_state IS DISTINCT FROM previous_to AS broken_chain
FROM (SELECT *, lag(to_state) OVER (PARTITION BY transaction_id ORDER BY created_at, id) AS previous_to FROM {state_log_gaps}) q) r WHERE bad_edge OR broken_chain""",
    "ledger_pair_audit": f"""
SELECT * FROM (SELECT s.transaction_id, count(l.id) FILTER (WHERE l.entry_type = 'DEBIT') AS debits, count(l.id) FILTER (WHERE l.entry_type = 'CREDIT') AS credits
FROM ({_LATEST}) s LEFT JOIN {{ledger_entries}} l ON l.transaction_id = s.transaction_id WHERE s.current_state = 'SETTLED' GROUP BY s.transaction_id) p
WHERE debits <> 1 OR credits <> 1""",
    "error_rate_5m": _error_rate(_FIVE, 0.01),
    "latency_quantiles_5m": _quantiles(_FIVE),
    "latency_quantiles_1d": _quantiles("date_trunc('day', ts)::TIMESTAMP"),
    "latency_sketch_5m": f"""
SELECT {_FIVE} AS window_start, count(latency) AS requests, round(quantile_disc(latency, 0.5), 6) AS p50, round(quantile_disc(latency, 0.99), 6) AS p99,
  quantile_disc(latency, 0.99) > 0.2 AS breach FROM {{request_log}} WHERE latency IS NOT NULL GROUP BY 1""",
    "request_rate_1m": "SELECT date_trunc('minute', ts)::TIMESTAMP AS window_start, round(count(*) / 60, 6) AS requests_per_second FROM {request_log} GROUP BY 1",
    "request_total": """SELECT minute, requests, sum(requests) OVER (ORDER BY minute)::BIGINT AS total_requests
FROM (SELECT date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS requests FROM {request_log} GROUP BY 1) m""",
    "alert_state": f"""
SELECT window_start, breach, count(*) FILTER (WHERE breach) OVER (ORDER BY window_start RANGE BETWEEN INTERVAL 4 HOUR PRECEDING AND CURRENT ROW) = 5 AS firing
FROM ({_error_rate("date_trunc('hour', ts)::TIMESTAMP", 0.15)}) e""",
    "stream_alert_state": f"""
SELECT window_start, breach, count(*) FILTER (WHERE breach) OVER (ORDER BY window_start RANGE BETWEEN INTERVAL 4 HOUR PRECEDING AND CURRENT ROW) = 5 AS firing
FROM ({_error_rate("date_trunc('hour', ts)::TIMESTAMP", 0.15)}) e""",
}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(text) for name, text in _SQL.items()}
