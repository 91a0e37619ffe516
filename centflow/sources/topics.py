"""Keyed JSON messages: reading a topic as a stream, and serialising rows for one."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from centflow import schemas as sc


# Microseconds and an offset, so that a message carries the exact instant.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def as_json(*columns: str) -> Column:
    """One JSON object of the columns."""
    return F.to_json(F.struct(*columns), JSON_OPTIONS)


def parse_messages(messages: DataFrame, schema: T.StructType = sc.VALIDATED_EVENT) -> DataFrame:
    """Columns of the JSON in ``value``."""
    return messages.select(F.from_json(F.col("value").cast("string"), schema).alias("data")).select("data.*")


def read_events(
    spark: SparkSession, fmt: str, schema: T.StructType = sc.VALIDATED_EVENT, path: str | None = None, **options
) -> DataFrame:
    """A stream of events from a topic (``kafka``), message files (``text``) or table files (``parquet``)."""
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        options = {"startingOffsets": "latest", "failOnDataLoss": "true", **options}
        return parse_messages(reader.options(**options).load(), schema)
    if fmt == "text":
        return parse_messages(reader.options(**options).load(path), schema)
    return reader.schema(schema).options(**options).load(path)


def to_topic(df: DataFrame, topic: str, key: str) -> DataFrame:
    """(topic, key, value): one JSON message per row, ready for a batch or streaming write."""
    return df.select(
        F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"),
        as_json(*df.columns).alias("value"),
    )


def publish(messages: DataFrame, fmt: str, **options) -> None:
    """Write all messages at once; the connector spreads them over the topics' partitions."""
    messages.write.format(fmt).options(**options).mode("append").save()
