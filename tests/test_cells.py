"""Stored cells: recall, sizes, files read."""

import re

import numpy as np
from pyspark.sql import functions as F

from tallyglass.operators import cells, vectors
from tallyglass.plans import identify


def clusters(spark, n=1500, d=16):
    """Sixteen clusters a language; a third of the rows are one vector."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, d))
    v = centres[rng.integers(0, 16, n)] + rng.normal(size=(n, d)) * 0.2
    v[: n // 3] = v[0]
    rows = [(k, "en" if k % 3 else "ja", [float(x) for x in r]) for k, r in enumerate(v)] + [(n, "en", None), (n + 1, None, [1.0] * d), (n + 2, "en", [0.0] * d)]
    return spark.createDataFrame(rows, "vec_id long, language string, embedding array<double>")


def test_recall_sizes_and_files(spark):
    d = clusters(spark)
    index = cells.build(vectors.keyed(d), most=60)
    sizes = index.rows().groupBy("language", "cell", "part").count()
    assert index.rows().count() == 1501 and sizes.agg(F.max("count")).first()[0] <= 2 * 60
    ask = d.filter("vec_id % 20 = 0 AND embedding IS NOT NULL AND language IS NOT NULL")
    found, exact = cells.search(vectors.keyed(ask), index, 6), vectors.knn_exact(ask, d, 10)
    assert vectors.recall(found, exact).first().recall >= 0.9
    sims = {(r.query_id, r.card_id): r.sim for r in vectors.knn_exact(ask, d, 2000).collect()}
    assert all(abs(sims[r.query_id, r.card_id] - r.sim) < 2e-6 for r in found.collect())


def test_only_the_cells_of_the_queries_are_read(spark):
    d = clusters(spark)
    index = cells.build(vectors.keyed(d), most=60)
    one = vectors.keyed(d.filter("vec_id = 1000"))
    found = cells.search(one, index, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*language[^\]]*cell", plan), plan[-3000:]
    assert found.count() == 10
    assert len(index.centres["en"]) > 12


def test_empty_and_unknown(spark):
    d = clusters(spark)
    index = cells.build(vectors.keyed(d), most=60)
    assert cells.search(vectors.keyed(d.limit(0)), index).count() == 0
    assert cells.search(vectors.keyed(d.filter("vec_id = 3")).withColumn("language", F.lit("fr")), index).count() == 0
    none = cells.build(vectors.keyed(d.limit(0)))
    assert cells.search(vectors.keyed(d.limit(9)), none).count() == 0


def test_registered_recall(spark, sf):
    assert identify.QUERIES["e3_stored_cells_recall"](spark, str(sf).replace("sf0.001", "sf0.01")).first().recall >= 0.9
