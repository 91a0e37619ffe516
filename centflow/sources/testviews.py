"""Payment tables derived from the generated test tables (see FIXTURES.md).

Each view is one SQL text that runs unchanged in Spark and in DuckDB; ``{name}`` stands for another
view or a stored table. Remainders of ids only choose which defect a row carries; no view leaves
rows out to be small.
"""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["events", "orders"]

_EVENT_TYPE = """CASE event_type WHEN 'purchase' THEN 'payment_intent.succeeded'
    WHEN 'error' THEN 'payment_intent.payment_failed' WHEN 'signup' THEN 'payment_intent.canceled'
    ELSE concat('charge.', event_type) END"""

VIEWS = {
    "payment_events": f"""
SELECT concat('evt_', CAST(event_id AS STRING)) event_id, {_EVENT_TYPE} event_type,
  CAST(round(value * 100) AS BIGINT) amount_cents, 'usd' currency,
  concat('cus_', CAST(user_id AS STRING)) stripe_customer_id,
  concat('merchant_', CAST(event_id % 5 AS STRING)) merchant_id, CAST(ts AS TIMESTAMP) received_at
FROM {{events}}""",
    # every sign-up is delivered a second time one hour later
    "deliveries": """
SELECT event_id, 0 seq, CAST(ts AS TIMESTAMP) received_at, event_type, value, user_id FROM {events}
UNION ALL
SELECT event_id, 1 seq, CAST(ts AS TIMESTAMP) + INTERVAL '1' HOUR received_at, event_type, value, user_id
FROM {events} WHERE event_type = 'signup'""",
    "webhook_received": f"""
SELECT concat('evt_', CAST(event_id AS STRING)) stripe_event_id, seq, {_EVENT_TYPE} event_type,
  CASE WHEN event_id % 61 = 0 THEN '{{{{"data":{{{{}}}}}}}}'
  ELSE concat('{{{{"data":{{{{"object":{{{{',
    CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN '"amount":"12",'
      WHEN event_id % 17 = 0 THEN '"amount":5.5,' WHEN event_id % 19 = 0 THEN '"amount":0,'
      WHEN event_id % 23 = 0 THEN '"amount":-500,' WHEN event_id % 29 = 0 THEN '"amount":true,'
      WHEN event_id % 31 = 0 THEN '"amount":null,'
      ELSE concat('"amount":', CAST(CAST(round(value * 100) AS BIGINT) AS STRING), ',') END,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE '"currency":"usd",' END,
    CASE WHEN event_id % 9 = 0 THEN '"customer":null,'
      ELSE concat('"customer":"cus_', CAST(user_id AS STRING), '",') END,
    CASE WHEN event_id % 10 = 0 THEN '"metadata":{{{{}}}}'
      ELSE concat('"metadata":{{{{"merchant_id":"merchant_', CAST(event_id % 5 AS STRING), '"}}}}') END,
    '}}}}}}}}}}}}') END payload,
  received_at
FROM {{deliveries}}""",
    # merchant_4 has no score on purpose
    "merchant_risk": """
SELECT merchant_id, max(score) score
FROM (SELECT concat('merchant_', CAST(event_id % 5 AS STRING)) merchant_id, CAST(event_id % 5 AS DOUBLE) / 5 score
      FROM {events}) m
WHERE merchant_id <> 'merchant_4' GROUP BY merchant_id""",
    # one per order, spread over the hours of the day; merchant_new never has a ledger row
    "txns": """
SELECT concat('txn_', CAST(o_orderkey AS STRING)) transaction_id, o_orderkey k, o_orderstatus st,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 200 = 0 THEN 'merchant_new'
    ELSE concat('merchant_', CAST(o_custkey % 50 AS STRING)) END merchant_id,
  CAST(round(o_totalprice * 100) AS BIGINT) amount_cents,
  CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 24) * INTERVAL '1' HOUR base_ts
FROM {orders}""",
    # F = settled, P = flagged, O = authorised
    "payment_state_log": """
SELECT t.k * 10 + s.seq id, t.transaction_id, s.from_state, s.to_state,
  concat('evt_', t.transaction_id, '_', s.to_state) event_id, t.merchant_id,
  t.base_ts + s.seq * INTERVAL '1' SECOND created_at
FROM {txns} t JOIN (VALUES
  ('F', 1, NULL, 'INITIATED'), ('F', 2, 'INITIATED', 'VALIDATED'), ('F', 3, 'VALIDATED', 'SCORING'),
  ('F', 4, 'SCORING', 'AUTHORIZED'), ('F', 5, 'AUTHORIZED', 'SETTLED'),
  ('P', 1, NULL, 'INITIATED'), ('P', 2, 'INITIATED', 'VALIDATED'), ('P', 3, 'VALIDATED', 'SCORING'),
  ('P', 4, 'SCORING', 'FLAGGED'),
  ('O', 1, NULL, 'INITIATED'), ('O', 2, 'INITIATED', 'VALIDATED'), ('O', 3, 'VALIDATED', 'SCORING'),
  ('O', 4, 'SCORING', 'AUTHORIZED')
) AS s(st, seq, from_state, to_state) ON t.st = s.st""",
    # k % 97 = 0 is imbalanced by one cent, k % 101 = 0 has a second DEBIT
    "ledger_entries": """
SELECT t.k * 10 + e.seq id, t.transaction_id,
  CASE WHEN e.seq = 2 AND t.k % 97 = 0 THEN t.amount_cents - 1 ELSE t.amount_cents END amount_cents,
  e.entry_type, t.merchant_id, 'USD' currency, t.transaction_id source_event_id,
  t.base_ts + INTERVAL '5' SECOND created_at
FROM {txns} t JOIN (VALUES (1, 'DEBIT'), (2, 'CREDIT'), (3, 'DEBIT')) AS e(seq, entry_type)
  ON (e.seq < 3 OR t.k % 101 = 0)
WHERE t.st = 'F'""",
    # amounts off by 150, some not succeeded, some without merchant, flagged ones missing in the ledger
    "processor_intents": """
SELECT transaction_id id, CASE WHEN k % 37 = 0 THEN amount_cents + 150 ELSE amount_cents END amount, 'usd' currency,
  CASE WHEN k % 41 = 0 THEN 'canceled' ELSE 'succeeded' END status,
  CASE WHEN k % 43 = 0 THEN NULL ELSE merchant_id END merchant_id, base_ts created
FROM {txns} WHERE st = 'F' OR (st = 'P' AND merchant_id IN ('merchant_1', 'merchant_new'))""",
    # the SCORING rows of one merchant got lost
    "state_log_gaps": """
SELECT * FROM {payment_state_log} WHERE NOT (to_state = 'SCORING' AND merchant_id = 'merchant_7')""",
    # DEBITs of one merchant removed, CREDITs of another changed, entry types of a third replaced
    "ledger_tampered": """
SELECT id, transaction_id,
  CASE WHEN merchant_id = 'merchant_5' AND entry_type = 'CREDIT' THEN amount_cents + 1 ELSE amount_cents END amount_cents,
  CASE WHEN merchant_id = 'merchant_8' AND entry_type = 'CREDIT' THEN 'REFUND' ELSE entry_type END entry_type,
  merchant_id, currency, source_event_id, created_at
FROM {ledger_entries} WHERE NOT (merchant_id = 'merchant_3' AND entry_type = 'DEBIT')""",
    # a replay: the first ten days are already scored, their successful payments already settled
    "done_states": """
SELECT concat('evt_', CAST(event_id AS STRING)) event_id,
  CASE WHEN event_type = 'purchase' THEN 'SETTLED' ELSE 'SCORING' END to_state
FROM {events} WHERE ts < TIMESTAMP '2024-01-11 00:00:00'""",
    # ledger rows booked by an earlier load
    "ledger_loaded": """
SELECT * FROM {ledger_entries} WHERE created_at < TIMESTAMP '1998-01-01 00:00:00'""",
    # features exist for the event types that pass validation
    "stored_features": """
SELECT event_id, 1.0E0 tx_velocity_1m, 2.0E0 tx_velocity_5m, CAST(amount_cents AS DOUBLE) / 1000 amount_zscore,
  0.5E0 merchant_risk_score, 0.0E0 device_switch_flag, CAST(NULL AS DOUBLE) hour_of_day,
  1.0E0 weekend_flag, CAST(amount_cents AS DOUBLE) / 100 amount_cents_log
FROM {payment_events} WHERE event_type LIKE 'payment_intent%'""",
    # a score both engines can compute: the cents of the amount, from 0 to 0.99
    "scored_input": """
SELECT p.*, CAST(amount_cents % 100 AS DOUBLE) / 100 risk_score,
  event_type LIKE 'payment_intent%' features_available
FROM {payment_events} p""",
    "ledger_messages": """
SELECT event_id k, CASE
  WHEN stripe_customer_id = 'cus_1' THEN '{{"event_id":'
  WHEN stripe_customer_id = 'cus_2' THEN concat('{{"event_id":"', event_id, '","merchant_id":"', merchant_id, '"}}')
  WHEN stripe_customer_id = 'cus_3' THEN concat('{{"event_id":"', event_id, '","amount_cents":"7","merchant_id":"', merchant_id, '"}}')
  WHEN stripe_customer_id = 'cus_4' THEN concat('{{"event_id":"","amount_cents":', CAST(amount_cents AS STRING), ',"merchant_id":"', merchant_id, '"}}')
  WHEN stripe_customer_id = 'cus_5' THEN concat('{{"event_id":"', event_id, '","amount_cents":', CAST(amount_cents AS STRING), ',"merchant_id":""}}')
  WHEN stripe_customer_id = 'cus_6' THEN concat('{{"event_id":"', event_id, '","amount_cents":-5,"merchant_id":"', merchant_id, '"}}')
  WHEN stripe_customer_id = 'cus_7' THEN concat('{{"amount_cents":', CAST(amount_cents AS STRING), ',"merchant_id":"', merchant_id, '"}}')
  ELSE concat('{{"event_id":"', event_id, '","amount_cents":', CAST(amount_cents AS STRING), ',"merchant_id":"', merchant_id,
    '","currency":"', currency, '","source_event_id":"src_', event_id, '"}}') END payload,
  received_at
FROM {payment_events}""",
    "request_log": """
SELECT event_id, CAST(ts AS TIMESTAMP) ts, event_type = 'error' is_error, value latency FROM {events}""",
}


# Forms for Spark of the two views that repeat each row: one scan and no join.
SPARK_VIEWS = {
    "payment_state_log": """
SELECT k * 10 + s.seq id, transaction_id, s.from_state, s.to_state, concat('evt_', transaction_id, '_', s.to_state) event_id,
  merchant_id, base_ts + s.seq * INTERVAL '1' SECOND created_at
FROM (SELECT *, explode(CASE st
  WHEN 'F' THEN array(named_struct('seq', 1, 'from_state', CAST(NULL AS STRING), 'to_state', 'INITIATED'),
    named_struct('seq', 2, 'from_state', 'INITIATED', 'to_state', 'VALIDATED'),
    named_struct('seq', 3, 'from_state', 'VALIDATED', 'to_state', 'SCORING'),
    named_struct('seq', 4, 'from_state', 'SCORING', 'to_state', 'AUTHORIZED'),
    named_struct('seq', 5, 'from_state', 'AUTHORIZED', 'to_state', 'SETTLED'))
  WHEN 'P' THEN array(named_struct('seq', 1, 'from_state', CAST(NULL AS STRING), 'to_state', 'INITIATED'),
    named_struct('seq', 2, 'from_state', 'INITIATED', 'to_state', 'VALIDATED'),
    named_struct('seq', 3, 'from_state', 'VALIDATED', 'to_state', 'SCORING'),
    named_struct('seq', 4, 'from_state', 'SCORING', 'to_state', 'FLAGGED'))
  WHEN 'O' THEN array(named_struct('seq', 1, 'from_state', CAST(NULL AS STRING), 'to_state', 'INITIATED'),
    named_struct('seq', 2, 'from_state', 'INITIATED', 'to_state', 'VALIDATED'),
    named_struct('seq', 3, 'from_state', 'VALIDATED', 'to_state', 'SCORING'),
    named_struct('seq', 4, 'from_state', 'SCORING', 'to_state', 'AUTHORIZED')) END) s FROM {txns}) t""",
    "ledger_entries": """
SELECT k * 10 + seq id, transaction_id,
  CASE WHEN seq = 2 AND k % 97 = 0 THEN amount_cents - 1 ELSE amount_cents END amount_cents,
  CASE WHEN seq = 2 THEN 'CREDIT' ELSE 'DEBIT' END entry_type, merchant_id, 'USD' currency,
  transaction_id source_event_id, base_ts + INTERVAL '5' SECOND created_at
FROM (SELECT *, explode(CASE WHEN k % 101 = 0 THEN array(1, 2, 3) ELSE array(1, 2) END) seq FROM {txns} WHERE st = 'F') t""",
}


def needs(text: str) -> list[str]:
    """The views and tables a text names, in order of first use."""
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


def view(spark: SparkSession, sf_dir: str, name: str, seen: dict[str, DataFrame] | None = None) -> DataFrame:
    """One derived table over the test tables in ``sf_dir``; ``seen`` keeps those already defined."""
    seen = {} if seen is None else seen
    if name not in seen:
        if name in TABLES:
            seen[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            text = SPARK_VIEWS.get(name, VIEWS[name])
            seen[name] = spark.sql(text, **{n: view(spark, sf_dir, n, seen) for n in needs(text)})
    return seen[name]


def with_views(query: str) -> str:
    """``query`` with the views it names as common table expressions, for an engine that has the raw tables."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for n in needs(text):
            if n not in TABLES and n not in ordered:
                visit(VIEWS[n])
                ordered.append(n)

    visit(query)
    plain = {n: n for n in [*TABLES, *VIEWS]}
    ctes = [f"{n} AS ({VIEWS[n].format(**plain)})" for n in ordered]
    body = query.format(**plain).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[len("WITH "):]
    return "WITH " + ",\n".join(ctes) + "\n" + body
