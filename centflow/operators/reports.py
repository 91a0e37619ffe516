"""Dashboard figures on top of the marts."""

from pyspark.sql import DataFrame, functions as F

from centflow import schemas as sc
from centflow.functions.scalar import usd


def filter_mart(mart: DataFrame, column: str, value: str = "All") -> DataFrame:
    return mart if value == "All" else mart.where(F.col(column) == value)


def filter_choices(mart: DataFrame, column: str) -> DataFrame:
    return mart.select(column).distinct().orderBy(column)


def kpi_fraud(mart: DataFrame) -> DataFrame:
    count = F.col("transaction_count")
    return mart.agg(
        F.sum(count).alias("total_transactions"),
        F.max("unique_merchants").alias("unique_merchants"),
        F.coalesce(F.sum(F.when(F.col("current_state") == sc.FLAGGED, count)), F.lit(0))
        .alias("flagged_transactions"),
    )


def kpi_volume(mart: DataFrame) -> DataFrame:
    """The average is the unweighted mean of the hourly averages, as on the dashboard."""
    return mart.agg(
        F.sum("settled_count").alias("total_settled"),
        usd(F.sum("total_amount_cents")).alias("total_volume_usd"),
        usd(F.avg("avg_amount_cents")).alias("avg_transaction_usd"),
    )


def kpi_merchant(mart: DataFrame) -> DataFrame:
    return mart.agg(
        F.count("*").alias("total_merchants"),
        usd(F.sum("total_settled_amount_cents")).alias("total_settled_usd"),
        F.sum("flagged_transactions").alias("total_flagged"),
    )


def kpi_recon(mart: DataFrame) -> DataFrame:
    return mart.agg(
        F.sum("discrepancy_count").alias("total_discrepancies"),
        F.sum("affected_transactions").alias("affected_transactions"),
        usd(F.sum("total_diff_cents")).alias("total_diff_usd"),
    )


def state_pivot(mart: DataFrame, states: list[str]) -> DataFrame:
    """Day by state matrix of transaction counts, 0 where a day lacks the state."""
    return mart.groupBy("metric_date").pivot("current_state", states).agg(F.sum("transaction_count")).na.fill(0)


def discrepancy_by_type(mart: DataFrame) -> DataFrame:
    return mart.groupBy("discrepancy_type").agg(F.sum("discrepancy_count").alias("discrepancy_count"))


def series(mart: DataFrame, index: str, measure: str) -> DataFrame:
    return mart.select(index, measure).orderBy(index)
