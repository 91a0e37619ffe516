"""The event lifecycle as one streaming query: webhook to settled ledger rows."""

from functools import partial

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQuery

from centflow import schemas as sc
from centflow.operators import lifecycle, validate as rules
from centflow.plans.scoring import Scorer, score_events
from centflow.sources.tables import read_features
from centflow.sources.topics import as_json, to_topic
from centflow.streaming.stateful import stream_first, stream_rate_limit
from centflow.streaming.windows import by_arrival, stream_dedup, trigger


def _store(df: DataFrame, tables: str, name: str, batch_id: int, *partition_by: str) -> DataFrame:
    """Write one micro-batch of a table; the same batch again replaces its own files only."""
    path = f"{tables}/{name}/batch_id={batch_id}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _observed(df: DataFrame, counts: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` whose next write also counts, without another pass."""
    seen = Observation()
    return df.observe(seen, *(c.alias(n) for n, c in counts.items())), seen


def process_batch(batch: DataFrame, batch_id: int, score: Scorer, tables: str, features: str | None) -> None:
    """Validate, score, route and book one micro-batch of deduplicated, rate-checked deliveries.

    What it reads does not grow with the batches before: ``first`` tells which event is to be scored, from the keyed
    state of the stream, and the stored features drop what has expired. Every table is derived from the stored form of the one before, so a step is computed once and a
    rerun of the batch after a failure writes the same files again.
    """
    spark = batch.sparkSession
    checked = _store(
        batch.withColumn("failure_reason", F.when(F.col("limited"), "RATE_LIMITED").otherwise(F.col("failure_reason"))),
        tables, "checked_events", batch_id,
    )
    if checked.isEmpty():
        return
    dead = rules.split_valid(checked.where("NOT limited"), F.current_timestamp())[1]
    first = rules.split_valid(checked.where("first"), F.current_timestamp())[0]
    if features is None:
        known = spark.createDataFrame([], "event_id string, " + ", ".join(f"{c} double" for c in sc.FEATURE_ORDER))
    else:
        known = read_features(spark, features)
    scoring, scored_seen = _observed(score_events(first, known, score), lifecycle.scored_counts())
    scored = _store(scoring, tables, "scored_events", batch_id)
    ways = lifecycle.route(scored)

    _store(to_topic(ways["alert"], sc.TOPIC_ALERT, "event_id"), tables, "alerts", batch_id)

    as_payload = ways["ledger"].select(
        as_json("*").alias("payload"), F.current_timestamp().alias("received_at")
    )
    booked = rules.validate_ledger(as_payload)
    good = booked.where(F.col("failure_reason").isNull())
    late = rules.dead_letters(booked, "event_id", sc.TOPIC_LEDGER, F.col("received_at"))
    letters, dead_seen = _observed(dead.unionByName(late), lifecycle.dead_counts())
    _store(letters, tables, "dlq", batch_id)
    entries = lifecycle.double_entry(good).withColumns({
        "id": F.xxhash64("transaction_id", "entry_type"), "created_at": F.current_timestamp(),
    })
    booking, settled_seen = _observed(entries.select(*sc.LEDGER_ENTRIES.fieldNames()), lifecycle.settled_counts())
    ledger = _store(booking, tables, "ledger_entries", batch_id)

    _store(
        ways["review"].select(
            F.col("event_id").alias("transaction_id"), "risk_score", as_json("*").alias("payload"),
            F.current_timestamp().alias("created_at"), F.lit("PENDING").alias("status"),
        ),
        tables, "manual_review_queue", batch_id,
    )
    settled = ledger.where("entry_type = 'DEBIT'").select(
        F.col("transaction_id").alias("event_id"), F.lit(True).alias("settled")
    )
    final = ways["state"].join(settled, "event_id", "left").select(
        "event_id", "event_type", F.when(F.col("settled"), sc.SETTLED).otherwise(F.col("final_state")).alias("final_state")
    )
    outcomes = checked.select(
        F.col("stripe_event_id").alias("event_id"), "event_type", "merchant_id", "received_at",
        F.when(F.col("failure_reason").isNotNull(), sc.FAILED).alias("failed"),
    ).join(final, ["event_id", "event_type"], "left")
    log = lifecycle.transitions(
        outcomes.withColumn("outcome", F.coalesce("failed", "final_state", F.lit(sc.VALIDATED)))
    ).withColumn("id", F.xxhash64("event_id", "to_state", "created_at"))
    _store(log.select(*sc.STATE_LOG.fieldNames()), tables, "payment_state_log", batch_id, "to_state")
    counters = scored_seen.get | dead_seen.get | settled_seen.get
    _store(spark.createDataFrame([counters], ", ".join(f"{n} long" for n in counters)), tables, "stage_counters", batch_id)


def checked_deliveries(received: DataFrame, limit: int = sc.RATE_LIMIT_PER_MINUTE,
                       once_seconds: int = sc.SCORED_TTL_SECONDS) -> DataFrame:
    """Drop repeated deliveries, apply the rules, count each merchant's quota and mark the delivery by which an
    event is scored, once in ``once_seconds``, all as one stream.
    """
    once = stream_dedup(by_arrival(received), ["stripe_event_id", "event_type"])
    ruled = rules.validate(once)
    renamed = ruled.withColumnRenamed("stripe_event_id", "event_id")
    limited = stream_rate_limit(renamed, limit)
    marked = stream_first(limited, F.col("failure_reason").isNull() & ~F.col("limited"), once_seconds)
    return marked.withColumnRenamed("event_id", "stripe_event_id").drop("position", "_arrived")


def start_lifecycle(
    received: DataFrame, score: Scorer, tables: str, checkpoint: str, features: str | None = None,
    limit: int = sc.RATE_LIMIT_PER_MINUTE, once: bool = False,
) -> StreamingQuery:
    """Start the lifecycle on a stream of received webhooks; results are tables under ``tables``."""
    sink = partial(process_batch, score=score, tables=tables, features=features)
    return (
        checked_deliveries(received, limit).writeStream.queryName("lifecycle")
        .outputMode("append").foreachBatch(sink)
        .option("checkpointLocation", checkpoint).trigger(**trigger(once)).start()
    )
