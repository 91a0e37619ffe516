"""Reconciliation of the ledger with the processor's records, any number of UTC days at once."""

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from centflow import schemas as sc


def _days(df: DataFrame, ts: str, start: date | None, end: date | None) -> DataFrame:
    """Rows of the UTC days ``start`` to ``end`` inclusive, with their ``run_date``.

    A stored ``run_date`` (``sources/bucketed.py``) is taken as it is, which keeps the table's buckets.
    """
    if "run_date" in df.columns:
        if start is not None:
            df = df.where(F.col("run_date") >= F.lit(start))
        return df if end is None else df.where(F.col("run_date") <= F.lit(end))
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start.isoformat()).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(ts) < F.lit((end + timedelta(days=1)).isoformat()).cast("timestamp"))
    return df.withColumn("run_date", F.to_date(ts))


def _matched(intents: DataFrame, ledger: DataFrame, start, end, id_col: str) -> DataFrame:
    """Succeeded intents left-joined to one DEBIT of the same id and day.

    Both sides are reduced to one row per (id, day) before the join: of several DEBITs the one with
    the largest id counts, of several intents with one id the earliest created. The join then uses
    the partitioning of the two aggregates.
    """
    kept = _days(intents.where(F.col("status") == "succeeded"), "created", start, end)
    kept = kept.groupBy(F.col(id_col).alias("transaction_id"), "run_date").agg(
        F.min_by(F.struct("amount", "currency", "merchant_id", "created"), F.struct("created", "amount"))
        .alias("p")
    )
    debits = _days(ledger.where(F.col("entry_type") == "DEBIT"), "created_at", start, end)
    debits = debits.groupBy("transaction_id", "run_date").agg(
        F.max_by(F.struct("amount_cents", "currency", "merchant_id"), "id").alias("l")
    )
    outcome = (
        F.when(F.col("l").isNull(), "MISSING_INTERNALLY")
        .when(F.col("p.amount") != F.col("l.amount_cents"), "AMOUNT_MISMATCH")
        .otherwise("CLEAN")
    )
    return kept.join(debits, ["transaction_id", "run_date"], "left").withColumn("outcome", outcome)


def recon_compare(
    intents: DataFrame, ledger: DataFrame, start: date | None = None, end: date | None = None, id_col: str = "id"
) -> DataFrame:
    """MISSING_INTERNALLY and AMOUNT_MISMATCH rows; equal amounts drop out."""
    missing = F.col("discrepancy_type") == "MISSING_INTERNALLY"

    def of(absent: Column, differing: Column) -> Column:
        return F.when(missing, absent).otherwise(differing)

    rows = _matched(intents, ledger, start, end, id_col).withColumnRenamed("outcome", "discrepancy_type")
    return rows.where(F.col("discrepancy_type") != "CLEAN").select(
        "transaction_id", "discrepancy_type",
        F.col("transaction_id").alias("stripe_payment_intent_id"),
        F.when(~missing, F.col("l.amount_cents")).alias("internal_amount_cents"),
        F.when(missing, F.col("p.amount")).alias("stripe_amount_cents"),
        F.when(~missing, F.col("p.amount") - F.col("l.amount_cents")).alias("diff_cents"),
        of(F.upper("p.currency"), F.col("l.currency")).alias("currency"),
        of(F.coalesce("p.merchant_id", F.lit("unknown")), F.col("l.merchant_id")).alias("merchant_id"),
        F.when(missing, F.col("p.created")).alias("stripe_created_at"),
        "run_date",
    )


def recon_run_counts(
    intents: DataFrame, ledger: DataFrame, start: date | None = None, end: date | None = None, id_col: str = "id"
) -> DataFrame:
    """Missing, mismatching and clean intents per run date."""
    def count(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    return _matched(intents, ledger, start, end, id_col).groupBy("run_date").agg(
        count("MISSING_INTERNALLY").alias("missing_count"),
        count("AMOUNT_MISMATCH").alias("mismatch_count"),
        count("CLEAN").alias("clean_count"),
    )


def recon_duplicates(ledger: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """DUPLICATE_LEDGER rows: transactions with more than two ledger rows in a UTC day.

    Any merchant of the transaction will do; the smallest one of the day's rows is taken in the same
    aggregate, so a run over a few days reads only those days.
    """
    per_day = _days(ledger, "created_at", start, end).groupBy("transaction_id", "run_date").agg(
        F.count("*").alias("n"), F.min("merchant_id").alias("merchant")
    )
    return per_day.where("n > 2").select(
        "transaction_id",
        F.lit("DUPLICATE_LEDGER").alias("discrepancy_type"),
        F.lit(None).cast("string").alias("stripe_payment_intent_id"),
        F.lit(None).cast("bigint").alias("internal_amount_cents"),
        F.lit(None).cast("bigint").alias("stripe_amount_cents"),
        F.lit(None).cast("bigint").alias("diff_cents"),
        F.lit("USD").alias("currency"),
        F.coalesce("merchant", F.lit("unknown")).alias("merchant_id"),
        F.lit(None).cast("timestamp").alias("stripe_created_at"),
        "run_date",
    )


def recon_all(compared: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One discrepancy table of all three types."""
    names = sc.DISCREPANCIES.fieldNames()
    return compared.select(*names).unionByName(duplicates.select(*names))
