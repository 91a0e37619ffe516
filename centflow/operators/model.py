"""Feature vectors, training and scoring with Spark ML."""

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from centflow import schemas as sc
from centflow.operators.lifecycle import apply_fallback, flag_scores
from centflow.operators.ordered import in_order, running_sum


def feature_vector(df: DataFrame) -> DataFrame:
    """Add ``features``: the eight features in canonical order."""
    return VectorAssembler(inputCols=sc.FEATURE_ORDER, outputCol="features").transform(df)


def in_training(key: str = "event_id", seed: int = 42) -> Column:
    """True for four rows of five, by a hash of the id: the same ones wherever and whenever it is asked."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(seed), key)), 1, 2) < "cd"


def split(df: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    return df.where(in_training(seed=seed)), df.where(~in_training(seed=seed))


def train(df: DataFrame, label: str = "label", seed: int = 42) -> PipelineModel:
    """Boosted trees: depth 4, step 0.1, 50 rounds, logistic loss."""
    trees = GBTClassifier(
        labelCol=label, featuresCol="features", maxDepth=4, stepSize=0.1, maxIter=50, seed=seed,
        checkpointInterval=10,
    )
    assembler = VectorAssembler(inputCols=sc.FEATURE_ORDER, outputCol="features")
    return Pipeline(stages=[assembler, trees]).fit(df)


def auc(model: PipelineModel, df: DataFrame, label: str = "label") -> float:
    return BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC").evaluate(model.transform(df))


def rank_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row ``auc``: the chance that a row with label 1 scores above one with label 0, ties counting half.

    Equal scores are counted first; the number of zeros below a score is a running count over ordered blocks.
    """
    counted = df.groupBy(F.lit(0).alias("_all"), F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_ones"), F.count_if(F.col(label) == 0).alias("_zeros"))
    ranked = in_order(counted, ["_all"], ["_score"], lambda part: running_sum(part, {"_upto": F.col("_zeros")}))
    below = F.sum(F.col("_ones") * (F.col("_upto") - F.col("_zeros") / 2))
    return ranked.agg((below / (F.sum("_ones") * F.sum("_zeros"))).alias("auc"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _tree(node) -> Column:
    """A node of a fitted tree and all below it as one expression; not a number goes right, as in the model."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    below = F.col(sc.FEATURE_ORDER[split.featureIndex()]).cast("double") <= F.lit(float(split.threshold()))
    return F.when(below, _tree(node.leftChild())).otherwise(_tree(node.rightChild()))


def compiled(model: PipelineModel) -> Column:
    """The risk score of a fitted model over the feature columns, without vectors and without the model.

    All features are continuous, so a tree is a nest of comparisons; trees are summed with their weights. A row with
    a null feature gets null, where the model itself fails.
    """
    boosted = model.stages[-1]
    trees = [_tree(t.rootNode()) * F.lit(float(w)) for t, w in zip(boosted._java_obj.trees(), boosted.treeWeights)]
    # the sum over an array keeps the trees out of one generated method, whose size is limited
    margin = F.aggregate(F.array(*trees), F.lit(0.0), lambda total, tree: total + tree)
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in sc.FEATURE_ORDER))
    return F.when(known, 1 / (1 + F.exp(-2 * margin)))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``risk_score`` and its flags; events without features go to manual review."""
    raw = model.transform(df).withColumn("risk_score", vector_to_array("probability")[1])
    flagged = flag_scores(raw.drop("features", "rawPrediction", "probability", "prediction"))
    return apply_fallback(flagged) if "features_available" in df.columns else flagged
