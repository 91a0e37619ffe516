"""Validation of raw webhook events and ledger messages; every failed rule leads to the DLQ."""

from pyspark.sql import Column, DataFrame, functions as F

from centflow import schemas as sc


def envelope(raw: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Project a raw processor event (``body`` JSON) to the received-event envelope."""
    body = F.try_parse_json("body")
    return raw.withColumn("_v", body).select(
        F.try_variant_get("_v", "$.id", "string").alias("stripe_event_id"),
        F.try_variant_get("_v", "$.type", "string").alias("event_type"),
        F.col("body").alias("payload"),
        (F.current_timestamp() if received_at is None else received_at).alias("received_at"),
    )


def _parsed_once(json: str) -> Column:
    """The parsed JSON as a generated row of its own.

    A filter on a rule would otherwise be pushed below the projection and parse the text again for
    every rule it names.
    """
    return F.explode(F.array(F.try_parse_json(json)))


def _kind(value: Column) -> Column:
    """The JSON type of a variant: BIGINT only for whole numbers, VOID for null, null if absent."""
    return F.schema_of_variant(value)


def extract_payment(df: DataFrame, default_merchant: str = sc.DEFAULT_MERCHANT) -> DataFrame:
    """Amount, currency, customer and merchant from ``payload``, with the defaults for absent ones.

    The helper columns ``_payload``, ``_object`` and ``_amount`` stay for the rules below.
    """
    parsed = df.withColumn("_payload", _parsed_once("payload")).withColumn(
        "_object", F.try_variant_get("_payload", "$.data.object", "variant")
    ).withColumn("_amount", F.try_variant_get("_object", "$.amount", "variant"))

    def text(path: str, default: str, for_null: str | None = None) -> Column:
        """The string at ``path``; the default if absent, and null if it is anything but a string."""
        value = F.try_variant_get("_object", path, "variant")
        return (
            F.when(value.isNull(), default)
            .when(_kind(value) == "STRING", F.try_variant_get("_object", path, "string"))
            .when(_kind(value) == "VOID", for_null)
        )

    whole = _kind(F.col("_amount")) == "BIGINT"
    return parsed.withColumns({
        "amount_cents": F.when(whole, F.try_variant_get("_amount", "$", "bigint")),
        "currency": text("$.currency", "usd"),
        "stripe_customer_id": text("$.customer", "", for_null=""),
        "merchant_id": text("$.metadata.merchant_id", default_merchant),
    })


def validate(df: DataFrame, default_merchant: str = sc.DEFAULT_MERCHANT) -> DataFrame:
    """Add the extracted columns, ``failure_detail`` (first failing rule) and ``failure_reason``."""
    amount = F.col("amount_cents")
    succeeded = F.col("event_type") == sc.SUCCEEDED
    absent = (
        F.col("stripe_event_id").isNull() | F.col("event_type").isNull()
        | F.col("_payload").isNull() | F.col("received_at").isNull()
    )
    detail = (
        F.when(absent, "envelope")
        .when(~F.col("event_type").isin(sc.SUPPORTED_EVENT_TYPES), "event_type")
        .when(F.coalesce(_kind(F.col("_object")), F.lit("VOID")) == "VOID", "object_missing")
        .when(F.col("_amount").isNull(), "amount_missing")
        .when(amount.isNull(), "amount_not_integer")
        .when(succeeded & (amount < 0), "amount_negative")
        .when(succeeded & (amount == 0), "amount_zero")
        .when(
            F.col("currency").isNull() | F.col("merchant_id").isNull() | F.col("stripe_customer_id").isNull(),
            "not_text",
        )
    )
    return (
        extract_payment(df, default_merchant)
        .withColumn("failure_detail", detail)
        .withColumn("failure_reason", F.when(F.col("failure_detail").isNotNull(), sc.SCHEMA_INVALID))
        .drop("_payload", "_object", "_amount")
    )


def valid_events(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("failure_reason").isNull()).select(
        F.col("stripe_event_id").alias("event_id"), "event_type", "amount_cents", "currency",
        "stripe_customer_id", "merchant_id", "received_at",
    )


def dead_letters(checked: DataFrame, key: str, topic: str, failed_at: Column, offset: Column | None = None) -> DataFrame:
    """The DLQ envelope of the failed rows."""
    return checked.where(F.col("failure_reason").isNotNull()).select(
        F.col(key).alias("event_id"),
        F.lit(topic).alias("original_topic"),
        (F.lit(None).cast("bigint") if offset is None else offset.cast("bigint")).alias("original_offset"),
        "failure_reason",
        F.lit(0).alias("retry_count"),
        failed_at.alias("first_failure_ts"),
        "payload",
        F.col("failure_detail").alias("error_detail"),
    )


def split_valid(checked: DataFrame, failed_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid events, dead letters) of a validated frame."""
    at = F.col("received_at") if failed_at is None else failed_at
    return valid_events(checked), dead_letters(checked, "stripe_event_id", sc.TOPIC_RECEIVED, at)


def validate_ledger(df: DataFrame) -> DataFrame:
    """Check ledger messages (``payload`` JSON); failures get ``LEDGER_WRITE_FAIL`` and a detail.

    The last rule is the ledger table's own constraint: only positive amounts can be booked.
    """
    def text(path: str) -> Column:
        value = F.try_variant_get("_v", path, "variant")
        return F.when(_kind(value) == "STRING", F.try_variant_get("_v", path, "string"))

    amount = F.try_variant_get("_v", "$.amount_cents", "variant")
    parsed = df.withColumn("_v", _parsed_once("payload")).withColumns({
        "_event": text("$.event_id"),
        "amount_cents": F.when(_kind(amount) == "BIGINT", F.try_variant_get("_v", "$.amount_cents", "bigint")),
        "merchant_id": text("$.merchant_id"),
        "_currency": F.try_variant_get("_v", "$.currency", "variant"),
        "_source": F.try_variant_get("_v", "$.source_event_id", "variant"),
    })
    detail = (
        F.when(F.col("_v").isNull(), "malformed_json")
        .when(F.col("amount_cents").isNull(), "amount_not_integer")
        .when(F.coalesce("_event", F.lit("")) == "", "event_id_empty")
        .when(F.coalesce("merchant_id", F.lit("")) == "", "merchant_id_empty")
        .when(F.col("amount_cents") <= 0, "amount_not_positive")
    )
    return parsed.withColumns({
        "event_id": F.coalesce(F.try_variant_get("_v", "$.event_id", "string"), F.lit("unknown")),
        "currency": F.when(F.col("_currency").isNull(), "usd").otherwise(text("$.currency")),
        "source_event_id": F.when(F.col("_source").isNull(), F.col("_event")).otherwise(text("$.source_event_id")),
        "failure_detail": detail,
        "failure_reason": F.when(detail.isNotNull(), sc.LEDGER_WRITE_FAIL),
    }).drop("_v", "_event", "_currency", "_source")
