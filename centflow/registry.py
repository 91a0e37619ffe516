"""Every operator as a named query over the test tables."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from centflow import schemas as sc
from centflow.functions.scalar import date_range, enrich, utc_day
from centflow.operators import digests, features, intake, lifecycle, marts, model, quality, recon, reports, service_metrics
from centflow.operators import validate as rules
from centflow.plans import incremental, reconciliation, scoring, warehouse
from centflow.session import configure, scratch_path, written
from centflow.sources import bucketed, key_index, tables, topics
from centflow.sources.testviews import VIEWS, needs, view
from centflow.streaming import alerts, carried, features as stream_features, lifecycle as stream_lifecycle, stateful, windows

DAY = date(1997, 2, 13)
FROM, TO = date(1996, 1, 1), date(1999, 6, 30)
STATES = [sc.AUTHORIZED, sc.FLAGGED, sc.SETTLED]


class Views:
    """Attribute access to the derived tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._seen = configure(spark), sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self._seen)

    @property
    def stg(self) -> DataFrame:
        return marts.stg_transactions(self.payment_state_log, self.ledger_entries)

    @property
    def fact(self) -> DataFrame:
        merchants = marts.dim_merchants(self.ledger_entries)
        return marts.fact_transactions(self.stg, merchants)

    @property
    def balanced(self) -> DataFrame:
        return marts.fact_ledger_balanced(marts.stg_ledger_entries(self.ledger_entries))

    @property
    def discrepancies(self) -> DataFrame:
        rows = reconciliation.reconcile(self.processor_intents, self.ledger_entries)
        return rows.withColumns({
            "id": reconciliation.discrepancy_id(), "created_at": F.col("run_date").cast("timestamp"),
        })

    @property
    def checked(self) -> DataFrame:
        return rules.validate(self.webhook_received)

    @property
    def scored(self) -> DataFrame:
        return lifecycle.apply_fallback(lifecycle.flag_scores(self.scored_input))

    def late_stream(self, name: str, slices: int = 3) -> DataFrame:
        """A view over the events as a stream of micro-batches that each span all times, so most rows come late."""
        events, path = self.spark.read.parquet(f"{self.sf_dir}/events.parquet"), scratch_path(self.spark, "slices")
        slot = F.pmod(F.xxhash64(*events.columns), F.lit(slices))
        for i in range(slices):
            events.where(slot == i).write.mode("append").parquet(path)
        files = len(self.spark.read.parquet(path).inputFiles())
        stream = self.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-files // slices)).parquet(path)
        return stream_view(self.spark, stream, name)

    def stream(self, name: str) -> DataFrame:
        """A view over the events as a stream of the events file."""
        raw = self.spark.read.parquet(f"{self.sf_dir}/events.parquet").schema
        events = self.spark.readStream.schema(raw).option("pathGlobFilter", "events.parquet").parquet(self.sf_dir)
        return stream_view(self.spark, events, name)


def stream_view(spark: SparkSession, events: DataFrame, name: str) -> DataFrame:
    if name == "events":
        return events
    return spark.sql(VIEWS[name], **{n: stream_view(spark, events, n) for n in needs(VIEWS[name])})


@contextmanager
def state_per_core(spark: SparkSession) -> Iterator[None]:
    """Start streams with no more state partitions than cores; a stream keeps the number it starts with."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _run(spark: SparkSession, jobs: dict, checkpoint: str) -> None:
    with state_per_core(spark):
        started = windows.start_all(spark, jobs, checkpoint, once=True)
    windows.wait_all(spark, started)


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all available input and read back what it wrote."""
    spark = df.sparkSession
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    _run(spark, {"drained": (df, mode, store)}, checkpoint)
    return spark.read.parquet(out)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _window_counts(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "merchant_id", "count"
    )


def _latest_windows(stored: DataFrame) -> DataFrame:
    """The final count of each window from update-mode batches."""
    return _window_counts(
        stored.groupBy("window", "merchant_id").agg(F.max_by("count", "batch_id").alias("count"))
    )


def _windows(v: Views, size: str, slide: str | None = None) -> DataFrame:
    return _window_counts(windows.velocity_windows(v.payment_events, size, slide))


def _velocity(v: Views, **sizes: int) -> DataFrame:
    return features.tx_velocity(v.payment_events, sizes).select("event_id", *sizes)


def _rate_limit(v: Views, limit: int, bucket: str) -> DataFrame:
    df = intake.rate_limit(v.payment_events, limit, bucket)
    return df.select("event_id", "merchant_id", "received_at", "position", "limited")


def _dedup(v: Views, ttl: int) -> DataFrame:
    df = v.webhook_received.select("stripe_event_id", "event_type", "seq", "received_at")
    return intake.dedup_ttl(df, ["stripe_event_id", "event_type"], "received_at", "seq", ttl)


def _labelled(v: Views) -> DataFrame:
    """Live features with a label the data determines: a failed payment."""
    label = v.payment_events.select(
        "event_id", (F.col("event_type") == "payment_intent.payment_failed").cast("double").alias("label")
    )
    return written(features.live_features(v.payment_events, v.merchant_risk).join(label, "event_id"), "labelled")


_fitted: dict[tuple[str, str], str] = {}


def _risk_model(v: Views, labelled: DataFrame):
    """The model of a folder's training events, fitted once per application, saved, and loaded."""
    known = v.spark.sparkContext.applicationId, v.sf_dir
    if known not in _fitted:
        path = scratch_path(v.spark, "risk-model")
        model.save(model.train(model.split(labelled)[0]), path)
        _fitted[known] = path
    return model.load(_fitted[known])


def _train_risk_model(v: Views) -> DataFrame:
    """Which events train the model; it is fitted on them, saved, and loaded to score the others."""
    labelled = _labelled(v)
    train, held_out = model.split(labelled)
    scored = model.score(_risk_model(v, labelled), held_out).select("event_id", "risk_score")
    sane = F.when(F.col("risk_score").between(0, 1), "held out").otherwise("bad score").alias("part")
    return train.select("event_id", F.lit("training").alias("part")).union(scored.select("event_id", sane))


def _score_auc(v: Views) -> DataFrame:
    label = (F.col("event_type") == "payment_intent.payment_failed").cast("int").alias("label")
    scored = v.payment_events.select((F.col("amount_cents") % 100).alias("score"), label)
    return rounded(model.rank_auc(scored, "score", "label"), "auc")


def _webhook_envelope(v: Views) -> DataFrame:
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), "amount_cents"))
    raw = v.payment_events.select(body.alias("body"), F.col("received_at").alias("at"))
    found = rules.envelope(raw, F.col("at"))
    return found.select("stripe_event_id", "event_type", "received_at", F.length("payload").alias("payload_chars"))


def _csv_seed(v: Views) -> DataFrame:
    """A view written as CSV files and read back with its types."""
    df, path = v.payment_events.select("event_id", "merchant_id", "amount_cents"), scratch_path(v.spark, "seed")
    df.write.option("header", True).csv(path)
    return tables.read_seed(v.spark, path, df.schema)


def _risk_score(v: Views) -> DataFrame:
    labelled = _labelled(v)
    scored = model.score(_risk_model(v, labelled), labelled)
    return scored.select("event_id", "risk_score", "is_high_risk", "manual_review")


def _risk_score_compiled(v: Views) -> DataFrame:
    """Every event, and whether the score compiled to a column equals that of the model."""
    labelled = _labelled(v)
    fitted = _risk_model(v, labelled)
    both = model.score(fitted, labelled).withColumn("_compiled", model.compiled(fitted))
    return both.select("event_id", (F.abs(F.col("risk_score") - F.col("_compiled")) <= 1e-9).alias("equal"))


def _model_auc(v: Views) -> DataFrame:
    labelled = _labelled(v)
    held_out = model.split(labelled)[1]
    return v.spark.createDataFrame([(model.auc(_risk_model(v, labelled), held_out),)], "auc double")


def _recon_bucketed(v: Views) -> DataFrame:
    """The comparison over tables stored by transaction and day."""
    names = []
    for df, id_column, ts in ((v.processor_intents, "id", "created"), (v.ledger_entries, "transaction_id", "created_at")):
        path = scratch_path(v.spark, "bucketed")
        names.append("recon_" + path.rsplit("-", 1)[1])
        bucketed.save_by_transaction(df, names[-1], id_column, ts, 8, path)
    return recon.recon_compare(*map(v.spark.table, names), id_col="transaction_id")


def _append_only_digests(v: Views) -> DataFrame:
    """The audit against a tree of digests that was stored with the old snapshot."""
    path = scratch_path(v.spark, "digests")
    digests.write_tree(digests.digest_tree(v.ledger_entries, "transaction_id", "created_at", 8), path)
    stored = digests.read_tree(v.spark, path)
    return digests.append_only_audit(v.ledger_entries, v.ledger_tampered, "transaction_id", "created_at", stored, ranges=8)


def _stream_alert_state(v: Views, parts: int = 4) -> DataFrame:
    """The log replayed in parts by time; a last request of a far time lets the watermark pass all others."""
    log, path = v.request_log, scratch_path(v.spark, "requests")
    span = log.agg(F.unix_seconds(F.min("ts")).alias("first"), F.unix_seconds(F.max("ts")).alias("last")).first()
    if span.first is not None:
        step = (span.last - span.first) // parts + 1
        part = F.floor((F.unix_seconds("ts") - span.first) / step)
        for i in range(parts):
            log.where(part == i).coalesce(1).write.mode("append").parquet(path)
    far = F.lit("2100-01-01 00:00:00").cast("timestamp")
    v.spark.range(1).select(far.alias("ts"), F.lit(False).alias("is_error")).coalesce(1).write.mode("append").parquet(path)
    stream = v.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = drained(alerts.stream_alerts(stream, size_seconds=3600, threshold=0.15, late="1 second"))
    return found.where("breach IS NOT NULL").select("window_start", "breach", "firing")


def _feature_vector(v: Views) -> DataFrame:
    """The vector's slots as columns, in canonical order."""
    df = model.feature_vector(features.live_features(v.payment_events, v.merchant_risk))
    slots = vector_to_array("features")
    return df.select("event_id", *[F.round(slots[i], 4).alias(f"f{i}") for i in range(len(sc.FEATURE_ORDER))])


def _messages(df: DataFrame) -> DataFrame:
    return df.select("topic", "key", "value")


def _feature_store_write(v: Views) -> DataFrame:
    df = features.reconstruct_features(v.payment_state_log, v.ledger_entries, v.merchant_risk)
    path = tables.write_feature_store(df, scratch_path(v.spark, "feature-store"), DAY)
    return _features_out(v.spark.read.parquet(path))


def _features_out(df: DataFrame) -> DataFrame:
    return rounded(df, "amount_zscore", "amount_cents_log")


def _warehouse_export(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "warehouse")
    days = v.discrepancies
    stored = scratch_path(v.spark, "discrepancies")
    tables.append(days, stored)
    table = v.spark.read.schema(days.schema).parquet(stored)
    exported = tables.export_run_date(table, DAY, path)
    out = v.spark.read.schema(days.schema).parquet(path) if exported else table.where(F.lit(False))
    return out.select("transaction_id", "discrepancy_type", "diff_cents", "merchant_id", "run_date")


def _append_rows(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "ledger")
    tables.append(v.ledger_loaded, path)
    key_index.idempotent_append(v.ledger_entries, path, ["transaction_id", "entry_type", "id"])
    return v.spark.read.schema(sc.LEDGER_ENTRIES).parquet(path)


def _append_history(v: Views) -> DataFrame:
    """Rows per year of a ledger that was loaded in two parts, odd years first, each part twice."""
    path, keys = scratch_path(v.spark, "history"), ["transaction_id", "entry_type", "id"]
    entries = written(v.ledger_entries, "ledger")
    for rest in (1, 1, 0, 0):
        key_index.idempotent_append(entries.where(F.year("created_at") % 2 == rest), path, keys)
    stored = v.spark.read.schema(sc.LEDGER_ENTRIES).parquet(path)
    return stored.groupBy(F.year("created_at").alias("year")).agg(
        F.count("*").alias("row_count"), F.sum("amount_cents").alias("amount_cents"))


def _velocity_upsert(v: Views) -> DataFrame:
    path, checkpoint = scratch_path(v.spark, "velocity"), scratch_path(v.spark, "velocity-checkpoint")
    fixed = F.lit("2024-02-01 00:00:00").cast("timestamp")
    job = {"velocity": (windows.velocity_1m(v.stream("payment_events")), "update", tables.velocity_sink(path, now=fixed))}
    _run(v.spark, job, checkpoint)
    return tables.read_velocity(v.spark, path, fixed).select("merchant_id", "epoch_minute", "count")


def _stored_features(v: Views, folder: str, now) -> DataFrame:
    found = tables.read_features(v.spark, f"{folder}/features", now).select("event_id", *sc.FEATURE_ORDER)
    return rounded(found, "amount_cents_log").withColumn("amount_zscore", F.round("amount_zscore", 4))


def _feature_upsert(v: Views) -> DataFrame:
    folder, checkpoint = scratch_path(v.spark, "features"), scratch_path(v.spark, "features-checkpoint")
    fixed = F.lit("2024-02-01 00:00:00").cast("timestamp")
    jobs = stream_features.feature_service(v.stream("payment_events"), v.merchant_risk, folder, fixed)
    _run(v.spark, {"features": jobs["features"]}, checkpoint)
    return _stored_features(v, folder, fixed)


def _feature_service(v: Views) -> DataFrame:
    """What the three jobs of the service leave in their stores."""
    folder, checkpoint = scratch_path(v.spark, "service"), scratch_path(v.spark, "service-checkpoint")
    fixed = F.lit("2024-02-01 00:00:00").cast("timestamp")
    _run(v.spark, stream_features.feature_service(v.stream("payment_events"), v.merchant_risk, folder, fixed), checkpoint)
    counts = [
        tables.read_velocity(v.spark, f"{folder}/{name}", fixed).agg(
            F.lit(name).alias("store"), F.count("*").alias("entries"), F.sum("count").cast("double").alias("total"))
        for name in ("velocity_1m", "velocity_5m")
    ]
    found = _stored_features(v, folder, fixed).agg(
        F.lit("features").alias("store"), F.count("*").alias("entries"), F.sum("tx_velocity_5m").alias("total"))
    return reduce(DataFrame.unionByName, counts, found)


def _stream_source(v: Views) -> DataFrame:
    """Message files on one side, the parsed stream of them on the other."""
    path = scratch_path(v.spark, "topic")
    topics.publish(topics.to_topic(v.payment_events, sc.TOPIC_VALIDATED, "event_id").select("value"), "text", path=path)
    return drained(topics.read_events(v.spark, "text", path=path)).drop("batch_id")


def _materialize(v: Views) -> DataFrame:
    built = warehouse.build_marts(
        v.spark, v.payment_state_log, v.ledger_entries, v.discrepancies, scratch_path(v.spark, "marts")
    )
    counts = [
        built[n].agg(F.count("*").alias("row_count")).select(F.lit(n).alias("model"), "row_count")
        for layer in warehouse.LAYERS.values() for n in layer
    ]
    return reduce(DataFrame.unionByName, counts)


def _marts_incremental(v: Views) -> DataFrame:
    """Merchant performance after two refreshes, each with half of the log and ledger rows of all times."""
    folder = scratch_path(v.spark, "incremental")
    log, ledger = written(v.payment_state_log, "log"), written(v.ledger_entries, "ledger")
    for half in range(2):
        rows = [df.where(F.pmod(F.xxhash64("id", "created_at"), F.lit(2)) == half) for df in (log, ledger)]
        incremental.refresh(v.spark, folder, *rows, buckets=8, period="yyyy")
    return rounded(incremental.read_marts(v.spark, folder)["merchant_performance"], "avg_transaction_amount_cents")


def _dq_tables(v: Views) -> dict[str, DataFrame]:
    return {
        "payment_state_log": v.payment_state_log, "ledger_entries": v.ledger_tampered,
        "reconciliation_discrepancies": v.discrepancies, "stg_transactions": v.stg,
        "stg_ledger_entries": marts.stg_ledger_entries(v.ledger_tampered),
        "dim_merchants": marts.dim_merchants(v.ledger_tampered), "dim_users": marts.dim_users(v.payment_state_log),
        "fact_ledger_balanced": marts.fact_ledger_balanced(v.ledger_tampered),
    }


def _dq(v: Views, rule: str) -> DataFrame:
    return quality.check(_dq_tables(v), (rule,)).drop("rule")


def _dq_not_null(v: Views) -> DataFrame:
    rows = [quality.null_counts(df, n, quality.NOT_NULL[n]) for n, df in _dq_tables(v).items()]
    extra = quality.null_counts(v.stg, "stg_transactions_amount", ["amount_cents"])
    return reduce(DataFrame.unionByName, rows, extra)


def _stream_zscore(v: Views) -> DataFrame:
    df = drained(stateful.stream_zscore(v.stream("payment_events")))
    return rounded(df.select("event_id", "amount_zscore"), "amount_zscore", digits=4)


def _carried(v: Views, sink: Callable, stream: DataFrame | None = None, **options) -> DataFrame:
    """What a sink with carried state leaves of the events."""
    state, out, checkpoint = (scratch_path(v.spark, n) for n in ("carried-state", "carried-out", "carried-checkpoint"))
    stream = v.stream("payment_events") if stream is None else stream
    _run(v.spark, {"carried": (stream, "append", sink(state, out, **options))}, checkpoint)
    return v.spark.read.parquet(out)


def _stream_zscore_carried(v: Views) -> DataFrame:
    return rounded(_carried(v, carried.zscore_sink).select("event_id", "amount_zscore"), "amount_zscore", digits=4)


def _per_day(df: DataFrame) -> DataFrame:
    """Per merchant and day, which do not depend on the order of arrival: events, counted and limited ones."""
    day = F.date_trunc("day", "received_at").alias("bucket")
    return df.groupBy("merchant_id", day).agg(
        F.count("*").alias("events"), F.count("position").alias("counted"), F.count_if("limited").alias("limited_events")
    )


def _stream_device(v: Views) -> DataFrame:
    return drained(stateful.stream_device_switch(v.stream("payment_events"))).select("event_id", "device_switch_flag")


def _stream_dedup(v: Views, received: DataFrame) -> DataFrame:
    df = drained(windows.stream_dedup(received, ["stripe_event_id", "event_type"]))
    return df.select("stripe_event_id", "event_type")


def _stream_rate_limit(v: Views) -> DataFrame:
    df = drained(stateful.stream_rate_limit(v.stream("payment_events"), 2, 86_400))
    return df.select("event_id", "position", "limited")


def _stream_rate_limit_late(v: Views) -> DataFrame:
    return _per_day(drained(stateful.stream_rate_limit(v.late_stream("payment_events"), 2, 86_400)))


def _stage_counters(v: Views) -> DataFrame:
    payload = lifecycle.ledger_message(v.scored).select(topics.as_json("*").alias("payload"), F.current_timestamp().alias("received_at"))
    booked = rules.validate_ledger(payload).where(F.col("failure_reason").isNull())
    return lifecycle.stage_counters(v.scored, rules.split_valid(v.checked)[1], lifecycle.double_entry(booked))


def _lifecycle_tables(v: Views, webhooks: DataFrame):
    """The tables that the stream leaves, by name."""
    folder, checkpoint = scratch_path(v.spark, "lifecycle"), scratch_path(v.spark, "lifecycle-checkpoint")
    cents = scoring.by_expression(F.col("amount_cents") % 100 / 100)
    received = webhooks.select(*sc.WEBHOOK_RECEIVED.fieldNames())
    with state_per_core(v.spark):
        query = stream_lifecycle.start_lifecycle(received, cents, folder, checkpoint, once=True)
    query.awaitTermination()
    return lambda table: v.spark.read.parquet(f"{folder}/{table}")


def _stream_feature_lookup(v: Views) -> DataFrame:
    """Features that reach the stream up to 20 seconds after or before their event, for a third of the events.

    A last event and feature of a far time let the watermark pass all others; they are left out of the result.
    """
    offset = F.timestamp_micros(F.unix_micros("received_at") + (F.col("amount_cents") % 40 - 20) * 1_000_000)
    events = v.payment_events.select("event_id", "amount_cents", "received_at")
    stored = events.where("amount_cents % 3 = 0").select("event_id", offset.alias("feature_ts"), *(F.lit(1.0).alias(c) for c in sc.FEATURE_ORDER))
    far = F.lit("2100-01-01 00:00:00").cast("timestamp")
    streams = []
    for name, df, ts in (("events", events, "received_at"), ("features", stored, "feature_ts")):
        end = df.limit(1).withColumns({"event_id": F.lit("end-of-" + name), ts: far})
        path = scratch_path(v.spark, name)
        df.unionByName(end).write.parquet(path)
        streams.append(v.spark.readStream.schema(df.schema).parquet(path))
    with state_per_core(v.spark):
        found = drained(windows.stream_feature_lookup(*streams, keep="1 minute"))
    return found.where("event_id <> 'end-of-events'").select("event_id", *sc.FEATURE_ORDER, "features_available")


def _stream_lifecycle(v: Views, webhooks: DataFrame) -> DataFrame:
    """Rows per state, entry type and failure in the tables that the stream leaves."""
    table_of = _lifecycle_tables(v, webhooks)
    kinds = {
        "payment_state_log": "to_state", "ledger_entries": "entry_type", "dlq": "failure_reason",
        "manual_review_queue": "status", "alerts": "topic",
    }
    counts = [
        table_of(table).groupBy(F.col(column).alias("kind"))
        .agg(F.count("*").alias("row_count")).select(F.lit(table).alias("table_name"), "kind", "row_count")
        for table, column in kinds.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _transitions(v: Views) -> DataFrame:
    outcome = F.when(F.col("event_type").startswith("charge"), sc.FAILED).when(
        F.col("risk_score") >= sc.HIGH_RISK, sc.FLAGGED
    ).when(F.col("event_type") == sc.SUCCEEDED, sc.SETTLED).otherwise(sc.AUTHORIZED)
    return lifecycle.transitions(v.scored.withColumn("outcome", outcome))


def _route(v: Views) -> DataFrame:
    ways = lifecycle.route(v.scored)
    named = [df.select(F.lit(n).alias("stream"), "event_id") for n, df in ways.items() if n != "state"]
    named.append(ways["state"].select(F.col("final_state").alias("stream"), "event_id"))
    return reduce(DataFrame.unionByName, named)


def _recon_args(v: Views):
    return v.processor_intents, v.ledger_entries


_QUERIES: dict[str, Callable[[Views], DataFrame]] = {
    # sources and sinks
    "stream_source": _stream_source,
    "state_log_scan": lambda v: date_range(v.payment_state_log, "created_at", FROM, TO),
    "feature_store_write": _feature_store_write,
    "velocity_upsert": _velocity_upsert,
    "feature_upsert": _feature_upsert,
    "feature_service": _feature_service,
    "csv_seed": _csv_seed,
    "webhook_envelope": _webhook_envelope,
    "topic_payload": lambda v: _messages(topics.to_topic(
        lifecycle.ledger_message(v.scored), sc.TOPIC_LEDGER, "event_id")),
    "publish_batch": lambda v: _messages(reconciliation.messages(reconciliation.reconcile(*_recon_args(v)))),
    "append_rows": _append_rows,
    "append_history": _append_history,
    "warehouse_export": _warehouse_export,
    "processor_window": lambda v: tables.succeeded_intents(v.processor_intents, DAY),
    "materialize": _materialize,
    "marts_incremental": _marts_incremental,
    # projections, filters, validation
    "extract_nested": lambda v: rules.extract_payment(v.webhook_received).select(
        "stripe_event_id", "seq", "amount_cents", "currency", "stripe_customer_id", "merchant_id"),
    "validate_events": lambda v: v.checked.select("stripe_event_id", "seq", "failure_reason", "failure_detail"),
    "valid_events": lambda v: rules.split_valid(v.checked)[0],
    "dlq_split": lambda v: rules.split_valid(v.checked)[1].drop("original_offset"),
    "ledger_validate": lambda v: rules.validate_ledger(v.ledger_messages).drop("payload", "received_at"),
    "state_transitions": _transitions,
    "route_scored": _route,
    "ledger_message": lambda v: lifecycle.ledger_message(v.scored),
    "double_entry": lambda v: lifecycle.double_entry(lifecycle.ledger_message(v.scored)),
    "stg_ledger_entries": lambda v: marts.stg_ledger_entries(v.ledger_entries),
    "utc_day_filter": lambda v: v.ledger_entries.where(utc_day("created_at", DAY)),
    "date_range_filter": lambda v: date_range(v.ledger_entries, "created_at", FROM, TO),
    "dashboard_filter": lambda v: reports.filter_mart(marts.dash_fraud_metrics(
        v.payment_state_log, v.ledger_entries), "current_state", sc.FLAGGED).drop("avg_amount_cents"),
    "dashboard_choices": lambda v: reports.filter_choices(marts.dash_merchant_performance(
        v.payment_state_log, v.ledger_entries), "merchant_id"),
    # joins
    "settled_history": lambda v: features.settled_history(v.payment_state_log, v.ledger_entries, FROM, TO),
    "settled_history_all": lambda v: features.settled_history(v.payment_state_log, v.ledger_entries),
    "stg_transactions": lambda v: v.stg,
    "fact_transactions": lambda v: v.fact,
    "recon_compare": lambda v: recon.recon_compare(*_recon_args(v)),
    "recon_compare_day": lambda v: recon.recon_compare(*_recon_args(v), DAY, DAY),
    "recon_compare_bucketed": _recon_bucketed,
    "merchant_risk_lookup": lambda v: features.with_merchant_risk(v.payment_events, v.merchant_risk).select(
        "event_id", "merchant_id", "merchant_risk_score"),
    "feature_lookup": lambda v: lifecycle.lookup_features(v.payment_events, v.stored_features).select(
        "event_id", *sc.FEATURE_ORDER, "features_available"),
    "stream_feature_lookup": _stream_feature_lookup,
    "skip_already_scored": lambda v: lifecycle.skip_done(v.payment_events, v.done_states, sc.SCORING),
    "skip_already_settled": lambda v: lifecycle.skip_done(v.payment_events, v.done_states, sc.SETTLED),
    "idempotent_append": lambda v: lifecycle.idempotent_rows(
        v.ledger_entries, v.ledger_loaded, ["transaction_id", "entry_type"]),
    # aggregations
    "fraud_metrics": lambda v: rounded(marts.fraud_metrics(v.fact), "avg_amount_cents"),
    "hourly_payment_volume": lambda v: rounded(marts.hourly_payment_volume(v.fact), "avg_amount_cents"),
    "merchant_performance": lambda v: rounded(
        marts.merchant_performance(v.fact, v.balanced), "avg_transaction_amount_cents"),
    "reconciliation_summary": lambda v: marts.reconciliation_summary(v.discrepancies),
    "fact_ledger_balanced": lambda v: v.balanced,
    "recon_duplicates": lambda v: recon.recon_duplicates(v.ledger_entries),
    "ledger_balance": lambda v: quality.ledger_balance(v.ledger_entries),
    "dim_merchants": lambda v: marts.dim_merchants(v.ledger_entries),
    "dim_users": lambda v: marts.dim_users(v.payment_state_log),
    "dash_fraud_metrics": lambda v: rounded(
        marts.dash_fraud_metrics(v.payment_state_log, v.ledger_entries), "avg_amount_cents"),
    "dash_payment_volume": lambda v: rounded(
        marts.dash_payment_volume(v.payment_state_log, v.ledger_entries), "avg_amount_cents"),
    "dash_merchant_performance": lambda v: rounded(
        marts.dash_merchant_performance(v.payment_state_log, v.ledger_entries), "avg_transaction_amount_cents"),
    "dash_reconciliation": lambda v: marts.in_mart_order(
        marts.reconciliation_summary(v.discrepancies), "reconciliation_summary"),
    "kpi_fraud": lambda v: reports.kpi_fraud(marts.dash_fraud_metrics(v.payment_state_log, v.ledger_entries)),
    "kpi_volume": lambda v: rounded(reports.kpi_volume(
        marts.dash_payment_volume(v.payment_state_log, v.ledger_entries)), "total_volume_usd", "avg_transaction_usd",
        digits=4),
    "kpi_merchant": lambda v: rounded(reports.kpi_merchant(
        marts.dash_merchant_performance(v.payment_state_log, v.ledger_entries)), "total_settled_usd", digits=4),
    "kpi_recon": lambda v: rounded(reports.kpi_recon(
        marts.reconciliation_summary(v.discrepancies)), "total_diff_usd", digits=4),
    "state_pivot": lambda v: reports.state_pivot(
        marts.dash_fraud_metrics(v.payment_state_log, v.ledger_entries), STATES),
    "discrepancy_by_type": lambda v: reports.discrepancy_by_type(marts.reconciliation_summary(v.discrepancies)),
    "volume_series": lambda v: reports.series(marts.dash_payment_volume(
        v.payment_state_log, v.ledger_entries), "payment_hour", "total_amount_cents"),
    "merchant_series": lambda v: reports.series(marts.dash_merchant_performance(
        v.payment_state_log, v.ledger_entries), "merchant_id", "total_settled_amount_cents"),
    "recon_run_counts": lambda v: recon.recon_run_counts(*_recon_args(v)),
    "stage_counters": _stage_counters,
    "stream_stage_counters": lambda v: _lifecycle_tables(v, v.stream("webhook_received"))("stage_counters").drop("batch_id").groupBy().sum()
    .toDF(*lifecycle.scored_counts(), *lifecycle.dead_counts(), *lifecycle.settled_counts()),
    "recon_all": lambda v: reconciliation.reconcile(*_recon_args(v)),
    # windows
    "latest_state": lambda v: marts.latest_state(v.payment_state_log),
    "tx_velocity_1m": lambda v: _velocity(v, tx_velocity_1m=60),
    "tx_velocity_5m": lambda v: _velocity(v, tx_velocity_5m=300),
    "tx_velocity_1h_6h": lambda v: _velocity(v, tx_velocity_1h=3600, tx_velocity_6h=21_600),
    "amount_zscore_running": lambda v: rounded(features.zscore_running(v.payment_events).select(
        "event_id", "amount_zscore"), "amount_zscore", digits=4),
    "amount_zscore_batch": lambda v: rounded(features.zscore_batch(v.payment_events).select(
        "event_id", "amount_zscore"), "amount_zscore"),
    "device_switch_flag": lambda v: features.device_switch(v.payment_events).select("event_id", "device_switch_flag"),
    "merchant_rate_limit": lambda v: _rate_limit(v, 100, "minute"),
    "merchant_rate_limit_1h": lambda v: _rate_limit(v, 1, "hour"),
    "merchant_rate_limit_2d": lambda v: _rate_limit(v, 2, "day"),
    "ingest_dedup": lambda v: _dedup(v, 86_400),
    "ingest_dedup_30m": lambda v: _dedup(v, 1_800),
    "ingest_dedup_hot": lambda v: intake.dedup_ttl(
        v.webhook_received.select("event_type", "seq", "received_at"), ["event_type"], "received_at", "seq", 3 * 3_600),
    # streaming
    "velocity_1m_windows": lambda v: _windows(v, "1 minute"),
    "velocity_5m_windows": lambda v: _windows(v, "5 minutes", "1 minute"),
    "stream_velocity_1m": lambda v: _latest_windows(drained(windows.velocity_1m(v.stream("payment_events")), "update")),
    "stream_velocity_5m": lambda v: _latest_windows(drained(windows.velocity_5m(v.stream("payment_events")), "update")),
    "enriched_events": lambda v: rounded(enrich(v.payment_events), "amount_cents_log"),
    "stream_enriched": lambda v: rounded(drained(enrich(v.stream("payment_events"))).drop("batch_id"), "amount_cents_log"),
    "stream_zscore": _stream_zscore,
    "stream_zscore_carried": _stream_zscore_carried,
    "stream_device_switch": _stream_device,
    "stream_device_switch_carried": lambda v: _carried(v, carried.device_sink).select("event_id", "device_switch_flag"),
    "stream_dedup": lambda v: _stream_dedup(v, v.stream("webhook_received")),
    "stream_dedup_late": lambda v: _stream_dedup(v, v.late_stream("webhook_received")),
    "stream_rate_limit": _stream_rate_limit,
    "stream_rate_limit_late": _stream_rate_limit_late,
    "stream_rate_limit_carried": lambda v: _per_day(_carried(
        v, carried.rate_limit_sink, v.late_stream("payment_events"), limit=2, bucket_seconds=86_400)),
    "stream_lifecycle": lambda v: _stream_lifecycle(v, v.stream("webhook_received")),
    "stream_lifecycle_late": lambda v: _stream_lifecycle(v, v.late_stream("webhook_received")),
    # model data
    "feature_vector": _feature_vector,
    "train_risk_model": _train_risk_model,
    "score_auc": _score_auc,
    "model_auc": _model_auc,
    "risk_score": _risk_score,
    "risk_score_compiled": _risk_score_compiled,
    "score_fallback": lambda v: v.scored.select("event_id", "risk_score", "is_high_risk", "manual_review"),
    "reconstruct_features": lambda v: _features_out(features.reconstruct_features(
        v.payment_state_log, v.ledger_entries, v.merchant_risk)),
    "reconstruct_features_range": lambda v: _features_out(features.reconstruct_features(
        v.payment_state_log, v.ledger_entries, v.merchant_risk, FROM, TO)),
    "live_features": lambda v: rounded(features.live_features(
        v.payment_events, v.merchant_risk).drop("received_at"), "amount_cents_log").withColumn(
        "amount_zscore", F.round("amount_zscore", 4)),
    # quality
    "dq_not_null": _dq_not_null,
    "dq_unique": lambda v: _dq(v, "unique"),
    "dq_accepted_values": lambda v: _dq(v, "accepted_values"),
    "assert_ledger_balanced": lambda v: quality.assert_ledger_balanced(v.balanced),
    "append_only_audit": lambda v: quality.append_only_audit(v.ledger_entries, v.ledger_tampered),
    "append_only_digests": _append_only_digests,
    "state_machine_audit": lambda v: quality.state_machine_audit(v.state_log_gaps),
    "ledger_pair_audit": lambda v: quality.ledger_pair_audit(v.payment_state_log, v.ledger_entries),
    # service metrics
    "error_rate_5m": lambda v: rounded(service_metrics.error_rate(v.request_log), "error_rate"),
    "latency_quantiles_5m": lambda v: rounded(service_metrics.latency_quantiles(v.request_log), "p50", "p99"),
    "latency_quantiles_1d": lambda v: rounded(service_metrics.latency_quantiles(v.request_log, "1 day"), "p50", "p99"),
    "latency_sketch_5m": lambda v: rounded(service_metrics.sketch_quantiles(service_metrics.rolled_up(
        service_metrics.latency_sketches(v.request_log), "5 minutes")), "p50", "p99"),
    "request_rate_1m": lambda v: rounded(service_metrics.request_rate(v.request_log), "requests_per_second"),
    "request_total": lambda v: service_metrics.request_total(v.request_log),
    "alert_state": lambda v: service_metrics.alert_state(service_metrics.error_rate(v.request_log, "1 hour", 0.15), 3600),
    "stream_alert_state": _stream_alert_state,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(f):
        return lambda spark, sf_dir: f(Views(spark, sf_dir))

    return {name: bound(f) for name, f in _QUERIES.items()}
