"""Scoring of validated events: feature lookup, a scorer, and the flags."""

from collections.abc import Callable
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame

from centflow import schemas as sc
from centflow.operators import lifecycle, model as ml

Scorer = Callable[[DataFrame], DataFrame]


def by_model(model: PipelineModel) -> Scorer:
    return partial(ml.score, model)


def by_expression(risk_score: Column) -> Scorer:
    """A scorer from a column over the event and its features, for rules and tests."""
    def score(df: DataFrame) -> DataFrame:
        return lifecycle.apply_fallback(lifecycle.flag_scores(df.withColumn("risk_score", risk_score)))
    return score


def score_events(events: DataFrame, features: DataFrame, score: Scorer) -> DataFrame:
    """Scored events with the flags; events without features get the defaults and a review."""
    return score(lifecycle.lookup_features(events, features)).drop(*sc.FEATURE_ORDER)
