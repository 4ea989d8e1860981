"""Decision-tree classification of labelled vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorIndexer, VectorIndexerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_vectors(df: DataFrame, label: str, array: str, *keep: str) -> DataFrame:
    """``label, features`` from a number and an array column."""
    return df.select(*keep, F.col(label).cast("double").alias("label"),
                     array_to_vector(F.col(array).cast("array<double>")).alias("features"))


def index_features(data: DataFrame, max_categories: int = 4) -> VectorIndexerModel:
    """Features with at most that many distinct values count as categories."""
    return VectorIndexer(inputCol="features", outputCol="indexedFeatures",
                         maxCategories=max_categories, handleInvalid="keep").fit(data)


def split(data: DataFrame, share: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    train, test = data.randomSplit([share, 1 - share], seed=seed)
    return train, test


def split_by_key(data: DataFrame, key: str, share: int = 7) -> tuple[DataFrame, DataFrame]:
    """A split that does not depend on row order: ``key mod 10 < share`` trains."""
    part = F.pmod(F.col(key), F.lit(10))
    return data.where(part < share), data.where(part >= share)


@dataclass
class TreeRun:
    model: PipelineModel
    predictions: DataFrame

    @property
    def tree_text(self) -> str:
        return self.model.stages[1].toDebugString

    def accuracy(self) -> float:
        return MulticlassClassificationEvaluator(
            labelCol="label", predictionCol="prediction", metricName="accuracy",
        ).evaluate(self.predictions)

    def test_error(self) -> float:
        return 1.0 - self.accuracy()


def train_tree(data: DataFrame, train: DataFrame, test: DataFrame, max_depth: int = 5) -> TreeRun:
    """Indexer fitted on all data, tree on ``train``, predictions for ``test``."""
    tree = DecisionTreeClassifier(labelCol="label", featuresCol="indexedFeatures",
                                  maxDepth=max_depth, seed=42)
    model = Pipeline(stages=[index_features(data), tree]).fit(train)
    return TreeRun(model, model.transform(test))
