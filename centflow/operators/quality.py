"""Data-quality checks and audits."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from centflow import schemas as sc
from centflow.operators.marts import latest_state
from centflow.operators.ordered import Part, in_order, previous

# The declared checks of the sources and models.
NOT_NULL = {
    "payment_state_log": ["transaction_id", "to_state", "merchant_id"],
    "ledger_entries": ["transaction_id", "entry_type", "amount_cents", "merchant_id"],
    "reconciliation_discrepancies": ["id", "transaction_id", "discrepancy_type", "merchant_id"],
    "stg_transactions": ["transaction_id"],
    "stg_ledger_entries": ["transaction_id", "entry_type"],
    "dim_merchants": ["merchant_id"],
    "dim_users": ["event_id"],
    "fact_ledger_balanced": ["transaction_id", "debit_amount_cents", "credit_amount_cents"],
}
UNIQUE = {
    "stg_transactions": "transaction_id",
    "dim_merchants": "merchant_id",
    "dim_users": "event_id",
    "fact_ledger_balanced": "transaction_id",
    "reconciliation_discrepancies": "id",
}
ACCEPTED = {
    "ledger_entries": ("entry_type", sc.ENTRY_TYPES),
    "stg_ledger_entries": ("entry_type", sc.ENTRY_TYPES),
    "reconciliation_discrepancies": ("discrepancy_type", sc.DISCREPANCY_TYPES),
}


def null_counts(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(table, column, failures): all columns of a table in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failures")) for c in columns])
    return counts.select(F.lit(table).alias("table_name"), F.inline(pairs))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("row_count")).where("row_count > 1")


def unaccepted(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Values outside the accepted set, with their row counts; null passes."""
    return df.where(~F.col(column).isin(values)).groupBy(column).agg(F.count("*").alias("row_count"))


RULES = ("not_null", "unique", "accepted_values")


def check(tables: dict[str, DataFrame], rules: tuple[str, ...] = RULES) -> DataFrame:
    """One row per declared rule with its number of failures, for the tables and kinds of rule given."""
    results = []
    for name, df in tables.items():
        if name in NOT_NULL and "not_null" in rules:
            results.append(
                null_counts(df, name, NOT_NULL[name]).select(
                    "table_name", "column_name", F.lit("not_null").alias("rule"), "failures"
                )
            )
        found = {}
        if name in UNIQUE and "unique" in rules:
            found["unique"] = UNIQUE[name], duplicate_keys(df, UNIQUE[name])
        if name in ACCEPTED and "accepted_values" in rules:
            column, values = ACCEPTED[name]
            found["accepted_values"] = column, unaccepted(df, column, values)
        for rule, (column, rows) in found.items():
            results.append(rows.agg(F.count("*").alias("failures")).select(
                F.lit(name).alias("table_name"), F.lit(column).alias("column_name"),
                F.lit(rule).alias("rule"), "failures",
            ))
    return reduce(DataFrame.unionByName, results)


def assert_ledger_balanced(balanced: DataFrame) -> DataFrame:
    """Rows whose sides differ; a missing side does not fail."""
    return balanced.where(F.col("debit_amount_cents") != F.col("credit_amount_cents")).select(
        "transaction_id", "debit_amount_cents", "credit_amount_cents", "merchant_id"
    )


def ledger_balance(ledger: DataFrame) -> DataFrame:
    """Transactions whose CREDITs and DEBITs do not cancel out."""
    amount = F.col("amount_cents")
    signed = F.when(F.col("entry_type") == "CREDIT", amount).when(F.col("entry_type") == "DEBIT", -amount)
    return ledger.groupBy("transaction_id").agg(
        F.sum(F.coalesce(signed, F.lit(0))).alias("balance_cents")
    ).where("balance_cents <> 0")


def append_only_audit(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the old snapshot that the new one lacks or holds with other values."""
    return old.exceptAll(new.select(*old.columns))


def state_machine_audit(state_log: DataFrame) -> DataFrame:
    """Log rows on an edge that does not exist, or that do not continue from the previous state."""
    edge = F.col("to_state") == sc.FAILED
    for a, b in sc.ALLOWED_EDGES:
        edge = edge | (F.col("from_state").eqNullSafe(F.lit(a)) & (F.col("to_state") == b))
    broken = ~F.col("from_state").eqNullSafe(F.col("previous_to"))
    columns = ["id", "transaction_id", "from_state", "to_state"]

    def broken_rows(part: Part) -> DataFrame:
        return (
            previous(part, {"to_state": "previous_to"})
            .withColumns({"bad_edge": ~edge, "broken_chain": broken})
            .where("bad_edge OR broken_chain")
            .select(*columns, "previous_to", "bad_edge", "broken_chain")
        )

    return in_order(
        state_log.select(*columns, "created_at"), ["transaction_id"], ["created_at", "id"], broken_rows
    )


def ledger_pair_audit(state_log: DataFrame, ledger: DataFrame) -> DataFrame:
    """Settled transactions without exactly one DEBIT and one CREDIT."""
    settled = latest_state(state_log).where(F.col("current_state") == sc.SETTLED).select("transaction_id")
    sides = ledger.groupBy("transaction_id").agg(
        F.count_if(F.col("entry_type") == "DEBIT").alias("debits"),
        F.count_if(F.col("entry_type") == "CREDIT").alias("credits"),
    )
    return settled.join(sides, "transaction_id", "left").na.fill(0, ["debits", "credits"]).where(
        "debits <> 1 OR credits <> 1"
    )
