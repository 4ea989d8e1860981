"""Decision tree over the embeddings, with a label that a tree can learn without error."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loomwork.catalog.registry import query, table
from loomwork.operators import aggregates
from loomwork.plans import tree

# two features of two values each decide the class; two more do not
_FEATURES = """array(IF(embedding[0] > 0, 5D, 2D), IF(embedding[1] > 0, 1D, -3D),
                     CAST(embedding[2] AS DOUBLE), IF(embedding[3] > 0.1, 7D, 0D))"""
_LABEL = """CASE WHEN embedding[{0}] > 0 AND embedding[{1}] > 0 THEN 3
                 WHEN embedding[{0}] > 0 THEN 2 WHEN embedding[{1}] > 0 THEN 1 ELSE 0 END"""
_TEST = f"""SELECT vec_id, CAST({_LABEL.format(1, 2)} AS DOUBLE) AS label
            FROM embeddings WHERE vec_id % 10 >= 7"""


def _data(spark, d):
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.expr(_LABEL.format(0, 1)).alias("label"), F.expr(_FEATURES).alias("features"))
    return tree.labelled_vectors(rows, "label", "features", "vec_id")


def _run(spark, d):
    data = _data(spark, d)
    return tree.train_tree(data, *tree.split_by_key(data, "vec_id"))


@query(f"SELECT vec_id, label AS prediction, label FROM ({_TEST})")
def tree_predictions(spark, d):
    return _run(spark, d).predictions.select("vec_id", "prediction", "label")


@query(f"SELECT avg(1.0::DOUBLE) AS accuracy, avg(0.0::DOUBLE) AS test_error FROM ({_TEST})")
def tree_accuracy(spark, d):
    return aggregates.accuracy(_run(spark, d).predictions)


@query("""SELECT vec_id, CAST(i AS INTEGER) AS position,
                 CASE i WHEN 0 THEN (embedding[1] > 0)::INT WHEN 1 THEN (embedding[2] > 0)::INT
                        WHEN 2 THEN CAST(embedding[3] AS DOUBLE)
                        ELSE (embedding[4] > 0.1)::INT END::DOUBLE AS value
          FROM embeddings, (SELECT unnest(range(4)) AS i)""")
def indexed_features(spark, d):
    """Features with few values become the numbers of these values, zero first."""
    data = _data(spark, d)
    return tree.index_features(data).transform(data).select(
        "vec_id", F.posexplode(vector_to_array("indexedFeatures")).alias("position", "value"))
