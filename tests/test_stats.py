"""Statistics of features over many tasks."""

import duckdb
from pyspark.sql import functions as F

from terrafold.operators.features import feature_stats
from terrafold.plans.catalogue import rounded_as_sql


def test_equal_values_have_no_deviation(spark):
    rows = spark.range(20_000).repartition(24).select(F.array(F.lit(1.0), F.lit(4.0), (F.col("id") % 2).cast("double")).alias("features"))
    got = {r.place: r.sd for r in feature_stats(rows).collect()}
    assert got[0] == got[1] == 1.0 and abs(got[2] - 0.5) < 1e-9


def test_halves_as_in_sql(spark):
    values = [k / 1_200_000 for k in range(3, 600_000, 606)]
    want = [r for (r,) in duckdb.sql(f"SELECT round(v, 6) FROM (SELECT unnest({values}::DOUBLE[]) AS v)").fetchall()]
    got = rounded_as_sql(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double"), "v").orderBy("i").collect()
    assert [r.v for r in got] == want
    plain = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select(F.round("v", 6).alias("v"), "i").orderBy("i").collect()
    assert [r.v for r in plain] != want
