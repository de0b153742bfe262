"""A forest's rows keep their nodes between levels; the trees stay those of before."""

import random

from pyspark.ml.linalg import Vectors

from vigilo.plans import models as M


def test_forest_keeps_nodes_and_grows_the_same_trees(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        x = [rng.gauss(0, 1), float(rng.random() < 0.3), rng.gauss(0, 1), float(rng.random() < 0.5)]
        rows.append((Vectors.dense(x), float(x[0] + x[1] + rng.gauss(0, 1) > 0), 1.0 + x[3]))
    data = spark.createDataFrame(rows, ["features", "label", "weight"]).coalesce(2).persist()
    forest = M.classifier("random_forest", numTrees=12)
    assert forest.getCacheNodeIds()
    kept, walked = forest.fit(data), M.classifier("random_forest", numTrees=12, cacheNodeIds=False).fit(data)
    data.unpersist()
    assert kept.toDebugString.split("\n", 1)[1] == walked.toDebugString.split("\n", 1)[1]
