"""Tables and files: reading, appending, exporting."""

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from centflow import schemas as sc
from centflow.functions.scalar import date_range, utc_day
from centflow.sources.expiring_store import ExpiringStore


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet",
    ts: str = "created_at", start: date | None = None, end: date | None = None, **options,
) -> DataFrame:
    """A stored table with optional bounds on ``ts`` that reach the scan."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return date_range(reader.load(path), ts, start, end)


def read_jdbc(spark: SparkSession, url: str, table: str, predicates: list[str], **properties) -> DataFrame:
    """A relational table, one task per predicate."""
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append-only insert. Rows of one partition value are brought together, large values over several files."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def write_feature_store(df: DataFrame, folder: str, run_date: date) -> str:
    """Write the feature table of a run date and return its path."""
    path = f"{folder}/features_{run_date:%Y%m%d}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def export_run_date(discrepancies: DataFrame, run_date: date, path: str) -> bool:
    """Append one run date's discrepancies to the warehouse folder; False if there are none."""
    rows = discrepancies.where(F.col("run_date") == F.lit(run_date))
    if rows.isEmpty():
        return False
    append(rows, path, ["run_date"])
    return True


def succeeded_intents(intents: DataFrame, day: date) -> DataFrame:
    """The processor's succeeded intents of one UTC day."""
    return intents.where(utc_day("created", day) & (F.col("status") == "succeeded")).select(
        "id", "amount", "currency", "created", "merchant_id"
    )


def read_intents(spark: SparkSession, path: str, day: date, fmt: str = "parquet") -> DataFrame:
    """``succeeded_intents`` from an export of the processor."""
    return succeeded_intents(spark.read.schema(sc.PROCESSOR_INTENTS).format(fmt).load(path), day)


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A typed CSV table with a header."""
    return spark.read.schema(schema).option("header", True).csv(path)


def velocity_store(path: str, ttl_seconds: int = sc.VELOCITY_TTL_SECONDS, now: Column | None = None) -> ExpiringStore:
    """Window counts under (merchant, epoch minute)."""
    return ExpiringStore(path, {"merchant_id": "string", "epoch_minute": "long"}, {"count": "long"}, ttl_seconds, now)


def feature_store(path: str, ttl_seconds: int = sc.FEATURE_TTL_SECONDS, now: Column | None = None) -> ExpiringStore:
    """The eight features under the event."""
    return ExpiringStore(path, {"event_id": "string"}, dict.fromkeys(sc.FEATURE_ORDER, "double"), ttl_seconds, now)


def velocity_sink(path: str, ttl_seconds: int = sc.VELOCITY_TTL_SECONDS, now: Column | None = None):
    """A foreachBatch function that upserts window counts under (merchant, epoch minute)."""
    store = velocity_store(path, ttl_seconds, now)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        minute = F.floor(F.unix_seconds("window.start") / 60)
        store.upsert(batch.select("merchant_id", minute.alias("epoch_minute"), "count"), batch_id)
    return upsert


def read_velocity(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    return velocity_store(path, now=now).read(spark)


def feature_sink(path: str, ttl_seconds: int = sc.FEATURE_TTL_SECONDS, now: Column | None = None):
    """A foreachBatch function that upserts the eight features of each event; nulls become 0."""
    store = feature_store(path, ttl_seconds, now)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        present = set(batch.columns)
        values = [
            F.coalesce(F.col(c).cast("double") if c in present else F.lit(None), F.lit(0.0)).alias(c)
            for c in sc.FEATURE_ORDER
        ]
        store.upsert(batch.select("event_id", *values), batch_id)
    return upsert


def read_features(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    return feature_store(path, now=now).read(spark)
