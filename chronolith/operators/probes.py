"""Whether features carry a signal: tree ensembles, projections and cluster quality, by Spark's own library."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audit import classification, majority_gain


def probe(train: DataFrame, test: DataFrame, columns: list[str], label: str, kind: str = "forest", seed: int = 42) -> DataFrame:
    """Test rows with `predicted`, by a forest or boosted trees."""
    make = RandomForestClassifier if kind == "forest" else GBTClassifier
    model = make(featuresCol="__f", labelCol=label, seed=seed, maxDepth=4, **({"numTrees": 30} if kind == "forest" else {"maxIter": 20}))
    fitted = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="__f"), model]).fit(train.dropna(subset=columns))
    return fitted.transform(test.dropna(subset=columns)).withColumn("predicted", F.col("prediction").cast("int")).drop("__f", "rawPrediction", "probability", "prediction")


def signal(train: DataFrame, test: DataFrame, columns: list[str], label: str, kind: str = "forest") -> DataFrame:
    """Accuracy against the majority, and confusion counts, of a probe."""
    got = probe(train, test, columns, label, kind)
    return majority_gain(got, "predicted", label).join(F.broadcast(classification(got, "predicted", label)), how="cross")  # one row each


def projection(df: DataFrame, columns: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """df with `projected` (first k components) and the share of variance each explains."""
    d = VectorAssembler(inputCols=columns, outputCol="__f").transform(df.dropna(subset=columns))
    model = PCA(k=k, inputCol="__f", outputCol="projected").fit(d)
    return model.transform(d).drop("__f"), [float(x) for x in model.explainedVariance]


def silhouette(df: DataFrame, columns: list[str], state: str = "state") -> float:
    """Mean silhouette of states, by squared distances."""
    d = VectorAssembler(inputCols=columns, outputCol="features").transform(df.dropna(subset=columns)).withColumn("prediction", F.col(state).cast("int"))
    return float(ClusteringEvaluator().evaluate(d))
