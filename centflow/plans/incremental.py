"""Facts and marts that follow appended log and ledger rows without a rebuild.

Stored are, by buckets of the transaction id, the latest log row of every transaction and the ledger rows; by day of the
latest state the staged transactions, each with what merchants' marts need of its ledger; and per day the partial
aggregates of the marts, which add up over days. A refresh reads and replaces

* the buckets that hold a transaction of the new rows,
* the days on which such a transaction stood or stands now,
* for merchants that were unknown so far, the days that have one of their transactions (partial aggregates only).

All other files stay as they are. A transaction stands on one day only, so counts of transactions and merchants'
sums add up over days; merchants per day and state are counted inside the day. Rows may be late by any time. All
replaced partitions become visible together (``partition_versions``).
"""


from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from centflow.operators import marts
from centflow.operators.skew import fan_out_left
from centflow.session import written
from centflow.sources.partition_versions import Tables, bucket

_LOG = ["transaction_id", "merchant_id", "to_state", "from_state", "event_id", "created_at", "id"]
_LEDGER = ["transaction_id", "merchant_id", "currency", "entry_type", "amount_cents", "created_at", "id"]


def _values(df: DataFrame, column: Column) -> set[str]:
    """Distinct partition names: buckets or days, a bounded number."""
    return {r[0] for r in df.select(column.cast("string")).distinct().collect() if r[0] is not None}


def _with_old(tables: Tables, name: str, parts: set[str], new: DataFrame) -> DataFrame:
    old = tables.read(name, parts)
    return new if old is None else old.unionByName(new)


def _day(period: str, column: str = "state_updated_at") -> Column:
    """The partition of a row; rows without a time have one of their own."""
    return F.coalesce(F.date_format(column, period), F.lit("none"))


def _staged(latest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Staged transactions with the number of their balanced ledger rows and of those that are off."""
    staged = marts.stg_transactions(latest, ledger)
    balanced = marts.fact_ledger_balanced(marts.stg_ledger_entries(ledger.withColumn("source_event_id", F.lit(None).cast("string"))))
    per_tx = balanced.groupBy("transaction_id").agg(F.count("*").alias("matches"), F.sum(marts._imbalanced()).alias("off"))
    return staged.join(per_tx, "transaction_id", "left")


def refresh(spark: SparkSession, folder: str, log: DataFrame, ledger: DataFrame, buckets: int = 64,
            period: str = "yyyy-MM-dd") -> set[str]:
    """Take new rows of the state log and the ledger into the tables; returns the days that were computed again.

    ``buckets`` and ``period``, the format of a day or of a longer partition where days hold little, are fixed by the
    first refresh of a folder. A refresh that broke off before its end left no trace and is
    done again with the same rows.
    """
    tables = Tables.open(spark, folder)
    log, ledger = written(log.select(*_LOG), "new-log"), written(ledger.select(*_LEDGER), "new-ledger")
    touched = written(log.select("transaction_id").unionByName(ledger.select("transaction_id")).distinct(), "touched")
    home = bucket("transaction_id", buckets)
    homes = _values(touched, home)

    # one log row per transaction: the latest of the stored and the new ones
    rest = F.struct(*(c for c in _LOG if c != "transaction_id"))
    both = _with_old(tables, "latest", homes, log)
    latest = written(both.groupBy("transaction_id").agg(F.max_by(rest, F.struct("created_at", "id")).alias("r"))
                     .select("transaction_id", "r.*").select(*_LOG), "latest")
    entries = written(_with_old(tables, "ledger", homes, ledger), "entries")
    before = tables.read("latest", homes)

    known = tables.read("merchants")
    merchants = marts.dim_merchants(ledger)
    if known is not None:
        merchants = merchants.join(known, "merchant_id", "left_anti")
    merchants = written(merchants, "new-merchants")

    own, ours = latest.join(touched, "transaction_id", "left_semi"), entries.join(touched, "transaction_id", "left_semi")
    staged = written(_staged(own, ours), "staged")
    days = _values(own, _day(period, "created_at"))
    if before is not None:
        days |= _values(before.join(touched, "transaction_id", "left_semi"), _day(period, "created_at"))
    stay = tables.read("staged", days)
    if stay is not None:
        staged = stay.join(touched, "transaction_id", "left_anti").unionByName(staged)

    tables.replace("latest", latest, home, homes)
    tables.replace("ledger", entries, home, homes)
    tables.replace("merchants", merchants, F.lit(str(tables.number + 1)), set())
    tables.replace("staged", staged, _day(period), days)
    counted = days
    present = tables.read("merchants_by_day")
    if known is not None and present is not None:
        counted = days | _values(present.join(merchants, "merchant_id", "left_semi"), F.col("day"))
    _count(tables, counted, period)
    tables.commit()
    return counted


def _count(tables: Tables, days: set[str], period: str) -> None:
    """The partial aggregates of some days."""
    staged = tables.read("staged", days)
    fact = written(marts.fact_transactions(staged, tables.read("merchants")), "fact")
    day = _day(period)
    tables.replace("merchants_by_day", staged.select("merchant_id", day.alias("day")).distinct(), F.col("day"), days)
    tables.replace("fraud", marts.fraud_metrics(fact), _day(period, "metric_date"), days)
    hourly = fact.where((F.col("current_state") == "SETTLED") & F.col("settled_at").isNotNull()).groupBy(
        day.alias("day"), F.date_trunc("hour", "settled_at").alias("payment_hour")).agg(
        F.count("*").alias("n"), F.count("amount_cents").alias("amounts"), F.sum("amount_cents").alias("total"),
        F.min("amount_cents").alias("least"), F.max("amount_cents").alias("most"))
    tables.replace("hourly", hourly, F.col("day"), days)
    per_tx = fact.groupBy(day.alias("day"), "merchant_id", "transaction_id", "matches", "off").agg(
        F.count("*").alias("rows"), F.sum(F.coalesce("amount_cents", F.lit(0))).alias("amount"),
        *(F.max(F.when(F.col("current_state") == s, 1)).alias(s.lower()) for s in ("SETTLED", "FLAGGED")))
    times, known = F.coalesce("matches", F.lit(1)), F.col("transaction_id").isNotNull()
    tables.replace("merchant", per_tx.groupBy("day", "merchant_id").agg(
        F.count("transaction_id").alias("transactions"), F.count(F.when(known, F.col("settled"))).alias("settled"),
        F.count(F.when(known, F.col("flagged"))).alias("flagged"), F.sum(F.col("amount") * times).alias("amount"),
        F.sum(F.col("rows") * times).alias("rows"), F.sum(F.col("rows") * F.coalesce("off", F.lit(0))).alias("off")),
        F.col("day"), days)


def read_marts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Fact and marts of the newest version, equal to a full build from all rows so far."""
    tables = Tables.open(spark, folder)
    fact = marts.fact_transactions(tables.read("staged"), tables.read("merchants")).drop("matches", "off")
    hourly, merchant = tables.read("hourly"), tables.read("merchant")
    return {
        "fact_transactions": fact,
        "fraud_metrics": tables.read("fraud"),
        "hourly_payment_volume": hourly.groupBy("payment_hour").agg(
            F.sum("n").alias("settled_count"), F.sum("total").alias("total_amount_cents"),
            (F.sum("total") / F.sum("amounts")).alias("avg_amount_cents"), F.min("least").alias("min_amount_cents"),
            F.max("most").alias("max_amount_cents")),
        "merchant_performance": merchant.groupBy("merchant_id").agg(
            F.sum("transactions").alias("total_transactions"), F.sum("settled").alias("settled_transactions"),
            F.sum("flagged").alias("flagged_transactions"), F.sum("amount").alias("total_settled_amount_cents"),
            (F.sum("amount") / F.sum("rows")).alias("avg_transaction_amount_cents"), F.sum("off").alias("imbalanced_transactions")),
    }
