"""The join by cells of several sizes against all pairs, and windows over a laid out table."""

import random

import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import curve, spatial
from terrafold.plans.lineage import cut

BOX = "id long, x0 double, y0 double, x1 double, y1 double"


def shapes(spark, rows, key):
    return spark.createDataFrame(rows, BOX).select(F.col("id").alias(key), G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geometry"))


def drawn(rng, n, sizes):
    out = []
    for i in range(n):
        w, h = (rng.choice(sizes) * rng.choice((0.5, 1, 1.5)) for _ in range(2))
        x, y = float(rng.randrange(-3000, 3000, 8)), float(rng.randrange(-3000, 3000, 8))
        out.append((i, x, y, x + w, y + h))
    return out


@pytest.mark.parametrize("sizes", [((4,), (4,)), ((4, 64, 256, 3000), (16, 512, 20000)), ((0,), (1024, 8))])
def test_candidates_against_all_pairs(spark, sizes):
    rng = random.Random(5)
    a, b = drawn(rng, 80, sizes[0]), drawn(rng, 60, sizes[1])
    a += [a[3], a[3]]  # repeated rows pair for themselves
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    got = spatial.candidates(shapes(spark, a, "l"), shapes(spark, b, "r"), "l", "r").select("l", "r").collect()
    assert sorted(map(tuple, got)) == want


def test_a_large_box_takes_few_cells(spark):
    boxes = curve.boxed(shapes(spark, [(1, 0.0, 0.0, 10000.0, 10000.0), (2, 5.0, 5.0, 9.0, 9.0)], "id"), "id")
    n = {r["row"]: r["count"] for r in curve.cells(boxes, curve.levels_of(boxes)).groupBy("row").count().collect()}
    assert max(n.values()) <= (curve.ACROSS + 1) ** 2 and min(n.values()) == 2  # the small one: its own level and the large one's


def test_no_rows_and_no_geometry(spark):
    a = shapes(spark, [(1, 0.0, 0.0, 1.0, 1.0)], "l")
    assert spatial.candidates(a.limit(0), a.withColumnRenamed("l", "r"), "l", "r").count() == 0
    none = a.withColumn("geometry", F.lit(None).cast(G.GEOMETRY))
    assert spatial.candidates(a.unionByName(none), a.withColumnRenamed("l", "r"), "l", "r").count() == 1
    laid = cut(curve.laid_out(a.unionByName(none)))
    assert laid.count() == 2 and curve.in_window(laid, -5, -5, 5, 5).count() == 1


def test_windows_are_pruned(spark, capsys):
    rows = [(i, float(i % 100 * 50), float(i // 100 * 50), i % 100 * 50 + 10.0, i // 100 * 50 + 10.0) for i in range(10000)]
    joined = "spark.sql.adaptive.coalescePartitions.enabled"  # a small table would be one file
    spark.conf.set(joined, "false")
    try:
        laid = cut(curve.laid_out(shapes(spark, rows, "id")))
    finally:
        spark.conf.unset(joined)
    found = curve.in_window(laid, 1000, 1000, 1260, 1400)
    assert {r.id for r in found.select("id").collect()} == {r[0] for r in rows if r[1] <= 1260 and r[3] >= 1000 and r[2] <= 1400 and r[4] >= 1000}
    found.select("id").explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(maxx,1000" in pushed and "LessThanOrEqual(minx,1260" in pushed
    files = found.select(F.input_file_name().alias("f")).distinct().count()
    assert files < len(laid.inputFiles())  # neighbours lie together


def test_the_curve_alternates_bits(spark):
    got = spark.range(16).select(curve.curve_key(F.col("id") % 4, F.floor(F.col("id") / 4)).alias("k")).collect()
    base = curve.curve_key(F.lit(0), F.lit(0))
    zero = spark.range(1).select(base.alias("k")).first().k
    want = [sum((v >> b & 1) << 2 * b + s for b in range(2) for s, v in ((0, i % 4), (1, i // 4))) for i in range(16)]
    assert [r.k - zero for r in got] == want
    far = spark.range(1).select(curve.curve_key(F.lit(10**12), F.lit(-(10**12))).alias("k")).first().k
    assert 0 <= far < 1 << 62
