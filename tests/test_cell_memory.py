"""Cell search by parts, and the memory of the visits of a large batch of queries."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyglass.operators import knn_join, vectors


def test_visits_hold_one_block(spark):
    rng = np.random.default_rng(1)
    pivots = rng.normal(size=(64, 8))
    pivots /= np.linalg.norm(pivots, axis=1)[:, None]
    stats = [type("R", (dict,), {"__getattr__": dict.get})(cell=c, near=0.3, far=1.6, short=1.0, long=9.0, n=knn_join.PART + c) for c in range(64)]
    n = 8000
    vectors_ = pa.array(rng.normal(size=(n, 8)).tolist(), pa.list_(pa.float64()))
    b = pa.RecordBatch.from_arrays([pa.array(["en"] * n), pa.array(np.arange(n)), vectors_, pa.array(np.zeros(n))], ["language", "id", "v", "least"])
    tracemalloc.start()
    met = sum(o.num_rows for o in knn_join._visits({"en": knn_join.Cells(pivots, stats)}, 10, True, -2.0, True)(iter([b])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the first cell alone holds one part, and each query leaves out the cell of its first round
    assert met > 1.9 * 63 * n and peak < 12 << 20


def test_all_cells_give_exact_search(spark, monkeypatch):
    """In parts of seven rows, with every cell probed."""
    monkeypatch.setattr(vectors, "PART", 7)
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(k, "en" if k % 3 else "ja", [float(x) for x in rng.normal(size=6)]) for k in range(200)], "vec_id long, language string, embedding array<double>")
    cells, centres = vectors.build_ivf(d, 4)
    found = vectors.knn_ivf(d.filter("vec_id < 40"), cells, centres, 4, 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, vectors.knn_exact(d.filter("vec_id < 40"), d, 5).collect()))
    assert found.groupBy("query_id").agg(F.count("*").alias("n")).filter("n = 5").count() == 40
    assert "MapInArrow" in found._jdf.queryExecution().toString()
