"""Labels show a similarity as printf and Python do: rounded by its exact binary value, half to even."""

from pyspark.sql import functions as F

from tallyglass.functions.exprs import two_places
from tallyglass.operators import vectors

VALUES = [n / 1000 for n in range(-1000, 1001)] + [n / 1_000_000 for n in range(0, 1_000_001, 997)] + [0.125, 0.375, 0.605, 0.6049999999999999, 0.6050000000000001, 12.345]


def test_two_places(spark):
    got = spark.createDataFrame([(x,) for x in VALUES], "x double").select("x", two_places(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got if r.t != f"{r.x:.2f}"] == []


def test_labels_of_hits_between_two_hundredths(spark):
    found = [(k, 1, x, 30, False, 1) for k, x in enumerate((0.605, 0.625, 0.615, 0.375))]
    r = vectors.classify_hits(spark.createDataFrame(found, "query_id long, card_id long, sim double, distance int, strong boolean, rank int"), 0.35, 0.45).orderBy("query_id").collect()
    assert [x.label for x in r] == [f"image:{x[2]:.2f}" for x in found]
