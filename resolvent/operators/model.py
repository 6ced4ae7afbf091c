"""Matchers on MLlib (ML): training, scoring, out-of-fold prediction, blending."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gbt(trees: int = 20, depth: int = 4, step: float = 0.3, seed: int = 42):
    """Boosted trees; 300 trees of depth 6 with step 0.08 is the full setting."""
    return GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.85, seed=seed)


def forest(trees: int = 30, depth: int = 6, seed: int = 42):
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)


def logistic(reg: float = 1e-4):
    return LogisticRegression(labelCol="label", featuresCol="features", regParam=reg)


def fit(pairs: DataFrame, features: list[str], learner) -> PipelineModel:
    """Features by name, in the given order; NaN counts as a value of its own for trees."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), learner]).fit(pairs)


def predict(model: PipelineModel, pairs: DataFrame, name: str = "prob") -> DataFrame:
    """``pairs`` with the probability of a match; the model's own columns are dropped."""
    out = model.transform(pairs).withColumn(name, vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def fold_of(c: str, k: int):
    """A fold by a hash of the record, so all its pairs share it."""
    return F.pmod(F.xxhash64(c), F.lit(k))


def out_of_fold(pairs: DataFrame, features: list[str], learner, k: int = 3, group: str = "s1_id", name: str = "prob") -> DataFrame:
    """Every pair scored by a model that saw no pair of its record."""
    x = pairs.withColumn("__fold", fold_of(group, k))
    out = None
    for i in range(k):
        part = predict(fit(x.where(F.col("__fold") != i), features, learner), x.where(F.col("__fold") == i), name)
        out = part if out is None else out.unionByName(part)
    return out.drop("__fold")


def ensemble_out_of_fold(pairs: DataFrame, features: list[str], k: int = 3, weights: tuple[float, ...] = (0.45, 0.40, 0.15), learners: tuple = ()) -> DataFrame:
    """A weighted blend of three learners with Platt scaling, both out of fold."""
    learners = learners or (gbt(), gbt(seed=7, depth=3), forest())
    x = pairs
    for i, m in enumerate(learners):
        x = out_of_fold(x, features, m, k, name=f"p{i}")
    blend = sum((F.col(f"p{i}") * w for i, w in enumerate(weights)), F.lit(0.0))
    x = x.withColumn("blend", blend)
    return out_of_fold(x, ["blend"], logistic(), k).drop("p0", "p1", "p2")


def fit_until_worse(pairs: DataFrame, features: list[str], trees: int = 50, tolerance: float = 0.01, held: float = 0.2, group: str = "s1_id") -> PipelineModel:
    """Boosted trees that stop when the loss on held-out records (a hash of the record) no longer falls by ``tolerance``."""
    x = pairs.withColumn("__held", F.pmod(F.xxhash64(group), F.lit(100)) < int(100 * held))
    learner = gbt(trees).setValidationIndicatorCol("__held")
    return fit(x, features, learner.copy({learner.validationTol: tolerance}))


def model_for(spark: SparkSession, path: str, mode: str, pairs: DataFrame, features: list[str], learner) -> PipelineModel:
    """``test`` loads the model at ``path``, ``retrain`` fits and replaces it, ``train`` fits only where none is."""
    if mode not in ("test", "train", "retrain"):
        raise ValueError(f"mode {mode!r}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    if mode == "test" and not there:
        raise FileNotFoundError(path)
    if there and mode != "retrain":
        return PipelineModel.load(path)
    model = fit(pairs, features, learner)
    model.write().overwrite().save(path)
    return model


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))

