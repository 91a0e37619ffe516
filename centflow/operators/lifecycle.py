"""From validated events to ledger rows: state transitions, scoring, routing and booking."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from centflow import schemas as sc
from centflow.functions.scalar import unit_interval
from centflow.operators.skew import spread_join


def transitions(outcomes: DataFrame, at: Column | None = None) -> DataFrame:
    """Log rows of each event that ended in ``outcome``: FAILED, VALIDATED, AUTHORIZED, FLAGGED or SETTLED.

    ``outcomes`` has event_id, merchant_id, received_at and outcome. Each step is stamped one
    microsecond after the one before, so that the log sorts in the order of the steps.
    """
    steps = {
        "FAILED": [(None, sc.INITIATED), (sc.INITIATED, sc.FAILED)],
        "VALIDATED": [(None, sc.INITIATED), (sc.INITIATED, sc.VALIDATED)],
    }
    scored = [*steps["VALIDATED"], (sc.VALIDATED, sc.SCORING)]
    steps["FLAGGED"] = [*scored, (sc.SCORING, sc.FLAGGED)]
    steps["AUTHORIZED"] = [*scored, (sc.SCORING, sc.AUTHORIZED)]
    steps["SETTLED"] = [*steps["AUTHORIZED"], (sc.AUTHORIZED, sc.SETTLED)]

    def rows(pairs) -> Column:
        return F.array(*[
            F.struct(
                F.lit(i).alias("seq"), F.lit(a).cast("string").alias("from_state"), F.lit(b).alias("to_state")
            )
            for i, (a, b) in enumerate(pairs, 1)
        ])

    path = F
    for name, pairs in steps.items():
        path = path.when(F.col("outcome") == name, rows(pairs))
    rows_of = outcomes.withColumn("_at", F.col("received_at") if at is None else at).select(
        F.col("event_id").alias("transaction_id"), "event_id", "merchant_id", "_at", F.inline(path)
    )
    stamped = F.timestamp_micros(F.unix_micros("_at") + F.col("seq"))
    return rows_of.withColumn("created_at", stamped).drop("_at", "seq")


def skip_done(events: DataFrame, state_log: DataFrame, state: str) -> DataFrame:
    """Drop events whose log already has ``state``."""
    done = state_log.where(F.col("to_state") == state).select("event_id").distinct()
    return spread_join(events, done, ["event_id"], "left_anti")


def lookup_features(events: DataFrame, features: DataFrame, defaults: dict[str, float] = sc.FEATURE_DEFAULTS) -> DataFrame:
    """Attach the stored features, or all the conservative defaults and ``features_available = false``."""
    stored = features.select("event_id", *sc.FEATURE_ORDER, F.lit(True).alias("features_available"))
    joined = spread_join(events, stored, ["event_id"], "left")
    return joined.withColumns({
        **{c: F.when(F.col("features_available"), F.coalesce(c, F.lit(0.0))).otherwise(F.lit(defaults[c]))
           for c in sc.FEATURE_ORDER},
        "features_available": F.coalesce("features_available", F.lit(False)),
    })


def flag_scores(scored: DataFrame) -> DataFrame:
    """Clamp ``risk_score`` to [0, 1] and set the two threshold flags."""
    return scored.withColumn("risk_score", unit_interval(F.col("risk_score"))).withColumns({
        "is_high_risk": F.col("risk_score") >= sc.HIGH_RISK,
        "manual_review": F.col("risk_score") >= sc.REVIEW_RISK,
    })


def apply_fallback(scored: DataFrame) -> DataFrame:
    """Without features a person must look at the event, whatever the score."""
    return scored.withColumn("manual_review", F.col("manual_review") | ~F.col("features_available"))


def final_state() -> Column:
    return F.when(F.col("risk_score") >= sc.HIGH_RISK, sc.FLAGGED).otherwise(sc.AUTHORIZED)


def ledger_message(scored: DataFrame) -> DataFrame:
    """The message of each authorised event that the ledger books."""
    return scored.where(final_state() == sc.AUTHORIZED).select(
        "event_id", "event_type", "amount_cents", "currency", "merchant_id",
        F.col("event_id").alias("source_event_id"), "stripe_customer_id", "risk_score",
    )


def route(scored: DataFrame) -> dict[str, DataFrame]:
    """The five streams a scored batch feeds."""
    state = scored.withColumn("final_state", final_state())
    return {
        "scored": scored,
        "alert": scored.where("is_high_risk"),
        "ledger": ledger_message(scored),
        "review": state.where((F.col("final_state") == sc.FLAGGED) & F.col("manual_review")).drop("final_state"),
        "state": state,
    }


def double_entry(messages: DataFrame) -> DataFrame:
    """One DEBIT and one CREDIT of the same amount per message."""
    kinds = F.explode(F.array(*[F.lit(k) for k in sc.ENTRY_TYPES]))
    return messages.select(
        F.col("event_id").alias("transaction_id"), "amount_cents", kinds.alias("entry_type"),
        "merchant_id", "currency", "source_event_id",
    )


def idempotent_rows(new: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose natural key the target does not hold yet."""
    return spread_join(new, target.select(*keys).distinct(), keys, "left_anti")


def scored_counts() -> dict[str, Column]:
    """What the scoring service reports of scored events, as aggregates."""
    flagged = F.col("risk_score") >= sc.HIGH_RISK
    return {
        "scored": F.count("*"), "flagged": F.count_if(F.col("is_high_risk")), "ledger_published": F.count_if(~flagged),
        "review_queued": F.count_if(flagged & F.col("manual_review")),
        "feature_misses": F.count_if(~F.col("features_available")),
    }


def settled_counts() -> dict[str, Column]:
    """What the ledger service reports of its entries: one DEBIT each makes a payment settled."""
    return {"settled": F.count_if(F.col("entry_type") == "DEBIT")}


def dead_counts() -> dict[str, Column]:
    return {"dead_letters": F.count("*")}


def stage_counters(scored: DataFrame, dead: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row with the counts the services report: scored, flagged, booked, queued, misses, dead letters, settled."""
    parts = ((scored, scored_counts()), (dead, dead_counts()), (ledger, settled_counts()))
    one = [df.agg(*(c.alias(n) for n, c in counts.items())) for df, counts in parts]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))
