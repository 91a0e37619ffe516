"""Staging, dimension, fact and mart relations, and the dashboard forms straight from the raw tables."""

from pyspark.sql import Column, DataFrame, functions as F

from centflow import schemas as sc
from centflow.operators.skew import fan_out_left, spread_join


def latest_state(state_log: DataFrame) -> DataFrame:
    """Last log row per transaction by (created_at, id).

    An aggregate rather than a window: transitions of one transaction are usually stored together,
    so the map side already reduces them to one row, and a hot transaction never meets in one task.
    """
    last = F.max_by(
        F.struct(
            "merchant_id", F.col("to_state").alias("current_state"),
            F.col("from_state").alias("previous_state"), "event_id",
            F.col("created_at").alias("state_updated_at"),
        ),
        F.struct("created_at", "id"),
    )
    return state_log.groupBy("transaction_id").agg(last.alias("s")).select("transaction_id", "s.*")


def _debits(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("entry_type") == "DEBIT")


def stg_ledger_entries(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        F.col("id").alias("ledger_entry_id"), "transaction_id", "amount_cents", "entry_type",
        "merchant_id", "currency", "source_event_id", "created_at",
    )


def stg_transactions(state_log: DataFrame, ledger: DataFrame) -> DataFrame:
    """Latest state with the DEBIT amount; one row per DEBIT, or one with nulls."""
    debits = _debits(ledger).select(
        "transaction_id", "amount_cents", "currency", F.col("created_at").alias("settled_at")
    )
    return fan_out_left(latest_state(state_log), debits, "transaction_id")


def dim_merchants(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("merchant_id").isNotNull()).select("merchant_id").distinct()


def dim_users(state_log: DataFrame) -> DataFrame:
    return state_log.where(F.col("event_id").isNotNull()).select("event_id").distinct()


def fact_transactions(stg: DataFrame, merchants: DataFrame) -> DataFrame:
    """Transactions of known merchants. The dimension is distinct, so the inner join is a semi join."""
    return spread_join(stg, merchants, ["merchant_id"], "left_semi")


def fact_ledger_balanced(stg_ledger: DataFrame) -> DataFrame:
    def side(kind: str) -> Column:
        return F.max(F.when(F.col("entry_type") == kind, F.col("amount_cents")))

    return stg_ledger.groupBy("transaction_id", "merchant_id", "currency").agg(
        side("DEBIT").alias("debit_amount_cents"),
        side("CREDIT").alias("credit_amount_cents"),
        F.min("created_at").alias("settled_at"),
    )


def fraud_metrics(fact: DataFrame) -> DataFrame:
    amount = F.coalesce("amount_cents", F.lit(0))
    return fact.groupBy(F.date_trunc("day", "state_updated_at").alias("metric_date"), "current_state").agg(
        F.count("*").alias("transaction_count"),
        F.countDistinct("merchant_id").alias("unique_merchants"),
        F.sum(amount).alias("total_amount_cents"),
        F.avg(amount).alias("avg_amount_cents"),
    )


def hourly_payment_volume(fact: DataFrame) -> DataFrame:
    settled = fact.where((F.col("current_state") == sc.SETTLED) & F.col("settled_at").isNotNull())
    return settled.groupBy(F.date_trunc("hour", "settled_at").alias("payment_hour")).agg(
        F.count("*").alias("settled_count"),
        F.sum("amount_cents").alias("total_amount_cents"),
        F.avg("amount_cents").alias("avg_amount_cents"),
        F.min("amount_cents").alias("min_amount_cents"),
        F.max("amount_cents").alias("max_amount_cents"),
    )


def _imbalanced() -> Column:
    """1 where both sides exist and differ."""
    return F.when(F.col("debit_amount_cents") != F.col("credit_amount_cents"), 1).otherwise(0)


def merchant_performance(fact: DataFrame, balanced: DataFrame) -> DataFrame:
    """Per merchant counts, amounts and imbalances of the fact left-joined to the balanced ledger.

    Both sides are first reduced to one row per transaction that remembers how many rows it stands
    for; the sums over the joined rows follow from these counts without building them.
    """
    known = F.col("transaction_id").isNotNull()
    per_tx = fact.groupBy("merchant_id", "transaction_id").agg(
        F.count("*").alias("rows"),
        F.sum(F.coalesce("amount_cents", F.lit(0))).alias("amount"),
        F.max(F.when(known & (F.col("current_state") == sc.SETTLED), 1)).alias("settled"),
        F.max(F.when(known & (F.col("current_state") == sc.FLAGGED), 1)).alias("flagged"),
    )
    per_ledger = balanced.groupBy("transaction_id").agg(
        F.count("*").alias("matches"), F.sum(_imbalanced()).alias("off")
    )
    joined = per_tx.join(per_ledger, "transaction_id", "left")
    times = F.coalesce("matches", F.lit(1))
    total, rows = F.sum(F.col("amount") * times), F.sum(F.col("rows") * times)
    return joined.groupBy("merchant_id").agg(
        F.count("transaction_id").alias("total_transactions"),
        F.count("settled").alias("settled_transactions"),
        F.count("flagged").alias("flagged_transactions"),
        total.alias("total_settled_amount_cents"),
        (total / rows).alias("avg_transaction_amount_cents"),
        F.sum(F.col("rows") * F.coalesce("off", F.lit(0))).alias("imbalanced_transactions"),
    )


def reconciliation_summary(discrepancies: DataFrame) -> DataFrame:
    return discrepancies.groupBy("run_date", "discrepancy_type").agg(
        F.count("*").alias("discrepancy_count"),
        F.countDistinct("transaction_id").alias("affected_transactions"),
        F.countDistinct("merchant_id").alias("affected_merchants"),
        F.sum(F.coalesce("diff_cents", F.lit(0))).alias("total_diff_cents"),
        F.min("created_at").alias("first_seen_at"),
        F.max("created_at").alias("last_seen_at"),
    )


def dash_fraud_metrics(state_log: DataFrame, ledger: DataFrame) -> DataFrame:
    """``fraud_metrics`` over all merchants, from the raw tables.

    DEBITs are reduced to (rows, sum) per transaction, so the join is one to one and needs no
    further shuffle: both aggregates are already partitioned by the transaction.
    """
    debits = _debits(ledger).groupBy("transaction_id").agg(
        F.count("*").alias("debits"), F.sum("amount_cents").alias("amount")
    )
    joined = latest_state(state_log).join(debits, "transaction_id", "left")
    rows = F.sum(F.coalesce("debits", F.lit(1)))
    total = F.sum(F.coalesce("amount", F.lit(0)))
    return joined.groupBy(F.date_trunc("day", "state_updated_at").alias("metric_date"), "current_state").agg(
        rows.alias("transaction_count"),
        F.countDistinct("merchant_id").alias("unique_merchants"),
        total.alias("total_amount_cents"),
        (total / rows).alias("avg_amount_cents"),
    )


def dash_payment_volume(state_log: DataFrame, ledger: DataFrame) -> DataFrame:
    """``hourly_payment_volume`` over all merchants, from the raw tables; DEBITs reduced per hour first."""
    settled = latest_state(state_log).where(F.col("current_state") == sc.SETTLED).select("transaction_id")
    hours = (
        _debits(ledger)
        .where(F.col("created_at").isNotNull())
        .groupBy("transaction_id", F.date_trunc("hour", "created_at").alias("payment_hour"))
        .agg(
            F.count("*").alias("n"), F.count("amount_cents").alias("valued"), F.sum("amount_cents").alias("total"),
            F.min("amount_cents").alias("low"), F.max("amount_cents").alias("high"),
        )
    )
    return hours.join(settled, "transaction_id", "left_semi").groupBy("payment_hour").agg(
        F.sum("n").alias("settled_count"),
        F.sum("total").alias("total_amount_cents"),
        (F.sum("total") / F.sum("valued")).alias("avg_amount_cents"),
        F.min("low").alias("min_amount_cents"),
        F.max("high").alias("max_amount_cents"),
    )


def dash_merchant_performance(state_log: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per merchant figures from the raw tables; the ledger is balanced per transaction only."""
    def side(kind: str) -> Column:
        return F.max(F.when(F.col("entry_type") == kind, F.col("amount_cents")))

    balanced = ledger.groupBy("transaction_id").agg(
        side("DEBIT").alias("debit_amount_cents"), side("CREDIT").alias("credit_amount_cents")
    )
    joined = latest_state(state_log).join(balanced, "transaction_id", "left")
    amount = F.coalesce("debit_amount_cents", F.lit(0))
    return joined.groupBy("merchant_id").agg(
        F.count("transaction_id").alias("total_transactions"),
        F.count_if(F.col("current_state") == sc.SETTLED).alias("settled_transactions"),
        F.count_if(F.col("current_state") == sc.FLAGGED).alias("flagged_transactions"),
        F.sum(amount).alias("total_settled_amount_cents"),
        F.avg(amount).alias("avg_transaction_amount_cents"),
        F.sum(_imbalanced()).alias("imbalanced_transactions"),
    )


# Read-time orders of the marts, all descending; a stored table has none.
MART_ORDER = {
    "fraud_metrics": ["metric_date", "transaction_count"],
    "hourly_payment_volume": ["payment_hour"],
    "merchant_performance": ["total_settled_amount_cents"],
    "reconciliation_summary": ["run_date", "discrepancy_count"],
}


def in_mart_order(mart: DataFrame, name: str) -> DataFrame:
    return mart.orderBy(*[F.desc(c) for c in MART_ORDER[name]])
