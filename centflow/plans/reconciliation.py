"""The nightly reconciliation as one job over any number of days."""

from datetime import date

from pyspark.sql import DataFrame, functions as F

from centflow.operators import recon
from centflow.sources.tables import append
from centflow.sources.topics import to_topic
from centflow import schemas as sc


def reconcile(
    intents: DataFrame, ledger: DataFrame, start: date | None = None, end: date | None = None, id_col: str = "id"
) -> DataFrame:
    """All discrepancies of the UTC days ``start`` to ``end``."""
    return recon.recon_all(
        recon.recon_compare(intents, ledger, start, end, id_col), recon.recon_duplicates(ledger, start, end)
    )


def persist(discrepancies: DataFrame, path: str) -> None:
    """Append discrepancies with their id and time of writing, by run date."""
    rows = discrepancies.withColumns({
        "id": discrepancy_id(), "created_at": F.current_timestamp(),
    })
    append(rows, path, ["run_date"])


def discrepancy_id():
    """The natural key as one string."""
    return F.concat_ws("|", "transaction_id", "discrepancy_type", F.col("run_date").cast("string"))


def messages(discrepancies: DataFrame) -> DataFrame:
    """The discrepancies as messages keyed by their transaction."""
    return to_topic(discrepancies, sc.TOPIC_RECONCILIATION, "transaction_id")
