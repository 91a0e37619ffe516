"""The model graph: staging views, stored dimensions, facts and marts."""

from pyspark.sql import DataFrame, SparkSession

from centflow.operators import marts

LAYERS = {
    "staging": ["stg_transactions", "stg_ledger_entries"],
    "tables": ["dim_merchants", "dim_users", "fact_transactions", "fact_ledger_balanced",
               "fraud_metrics", "hourly_payment_volume", "merchant_performance", "reconciliation_summary"],
}


def build_marts(
    spark: SparkSession, state_log: DataFrame, ledger: DataFrame, discrepancies: DataFrame, folder: str
) -> dict[str, DataFrame]:
    """Build every model in dependency order: staging as views, the rest stored under ``folder``.

    Each stored model is read back, so later models start from its files and not from its plan.
    """
    def stored(name: str, df: DataFrame) -> DataFrame:
        path = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    out = {
        "stg_transactions": marts.stg_transactions(state_log, ledger),
        "stg_ledger_entries": marts.stg_ledger_entries(ledger),
    }
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    out["dim_merchants"] = stored("dim_merchants", marts.dim_merchants(ledger))
    out["dim_users"] = stored("dim_users", marts.dim_users(state_log))
    out["fact_transactions"] = fact = stored(
        "fact_transactions",
        marts.fact_transactions(out["stg_transactions"], out["dim_merchants"]),
    )
    out["fact_ledger_balanced"] = balanced = stored(
        "fact_ledger_balanced", marts.fact_ledger_balanced(out["stg_ledger_entries"])
    )
    out["fraud_metrics"] = stored("fraud_metrics", marts.fraud_metrics(fact))
    out["hourly_payment_volume"] = stored("hourly_payment_volume", marts.hourly_payment_volume(fact))
    out["merchant_performance"] = stored("merchant_performance", marts.merchant_performance(fact, balanced))
    out["reconciliation_summary"] = stored("reconciliation_summary", marts.reconciliation_summary(discrepancies))
    return out
