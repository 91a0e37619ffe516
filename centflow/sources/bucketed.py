"""Ledger and processor records stored for the nightly comparison, so that it shuffles neither.

Both tables are bucketed by (transaction, UTC day) into the same number of buckets and sorted by day inside a
file, so a run over a few days skips most row groups. The day is stored as ``run_date``; ``recon`` takes it from there.
"""

from pyspark.sql import DataFrame, functions as F

KEYS = ["transaction_id", "run_date"]


def save_by_transaction(df: DataFrame, table: str, id_column: str, ts: str, buckets: int, path: str | None = None) -> None:
    """Add rows to ``table``, which is created if it does not exist; one file per bucket and call.

    Choose ``buckets`` for the whole table (about its size / 200 MB). A hot transaction stays in one bucket: its rows
    of a day are reduced where they lie.
    """
    rows = df.withColumns({"transaction_id": F.col(id_column), "run_date": F.to_date(ts)})
    if id_column != "transaction_id":
        rows = rows.drop(id_column)
    writer = rows.repartition(buckets, *KEYS).write.mode("append").bucketBy(buckets, *KEYS).sortBy("run_date", "transaction_id")
    (writer.option("path", path) if path else writer).saveAsTable(table)
