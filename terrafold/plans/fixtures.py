"""Geometry derived from the star-schema tables, the same in Spark and in SQL.

Every part is a rectangle in a district of 25; the embeddings of one label are
the nodes of a graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import similarity
from terrafold.plans.lineage import cut

#: Districts lie side by side, so far apart, where a query joins by place.
SPREAD = 200
THRESHOLD = 0.15

SQL_BUILDING = """
b AS (SELECT CAST(FLOOR(p_partkey/25) AS BIGINT) AS district_id, p_partkey+1 AS building_id,
  CAST((p_partkey%25)%5*12 + p_size%4 AS BIGINT) AS minx,
  CAST(FLOOR((p_partkey%25)/5)*12 + p_partkey%3 AS BIGINT) AS miny,
  CAST((p_partkey%25)%5*12 + p_size%4 + 3 + p_size%5 AS BIGINT) AS maxx,
  CAST(FLOOR((p_partkey%25)/5)*12 + p_partkey%3 + 3 + p_partkey%5 AS BIGINT) AS maxy,
  CAST(1 + p_partkey%9 AS INT) AS label FROM part),
d AS (SELECT DISTINCT district_id, CAST(60 + 40*(district_id%2) AS BIGINT) AS maxx FROM b)"""
SQL_NODE = """
n AS (SELECT CAST(label AS BIGINT) AS district_id, vec_id AS building_id, CAST(embedding AS DOUBLE[]) AS features FROM embeddings),
pair AS (SELECT a.district_id, a.building_id AS i, c.building_id AS j, list_cosine_similarity(a.features, c.features) AS cosine
  FROM n a JOIN n c ON a.district_id = c.district_id AND a.building_id <= c.building_id),
e AS (SELECT district_id, i AS src, j AS dst, 1 - cosine AS distance FROM pair WHERE i < j AND cosine >= 0.15
  UNION ALL SELECT district_id, j, i, 1 - cosine FROM pair WHERE i < j AND cosine >= 0.15)"""
SQL_PRED = """
centre AS (SELECT district_id AS c, k, avg(features[k]) AS m FROM n, range(1, 65) t(k) GROUP BY ALL),
near AS (SELECT n.building_id, n.district_id, centre.c, sum((n.features[k] - m) * (n.features[k] - m)) AS dist
  FROM n, centre GROUP BY ALL),
p AS (SELECT building_id, CAST(district_id AS INT) AS y, CAST(arg_min(c, round(dist, 9) * 1000 + c / 1e9) AS INT) AS pred FROM near GROUP BY ALL)"""


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    x = (k % 25 % 5 * 12 + s % 4).cast("long")
    y = (F.floor(k % 25 / 5) * 12 + k % 3).cast("long")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.floor(k / 25).cast("long").alias("district_id"),
        (k + 1).alias("building_id"),
        x.alias("minx"),
        y.alias("miny"),
        (x + 3 + s % 5).cast("long").alias("maxx"),
        (y + 3 + k % 5).cast("long").alias("maxy"),
        (1 + k % 9).cast("int").alias("label"),
    )


def buildings(spark: SparkSession, sf_dir: str, spread: int = 0) -> DataFrame:
    r = rectangles(spark, sf_dir)
    shift = F.col("district_id") * spread
    shape = G.rectangle(F.col("minx") + shift, F.col("miny"), F.col("maxx") + shift, F.col("maxy"))
    return r.select("district_id", "building_id", "label", shape.alias("geometry"), F.col("building_id").alias("position"))


def districts(spark: SparkSession, sf_dir: str, spread: int = 0) -> DataFrame:
    ids = rectangles(spark, sf_dir).select("district_id").distinct()
    shift, width = F.col("district_id") * spread, 60 + 40 * (F.col("district_id") % 2)
    shape = G.rectangle(shift, F.lit(0), shift + width, F.lit(60))
    grid = F.struct(
        shift.cast("double").alias("x0"), F.lit(60.0).alias("y1"), F.lit(1.0).alias("xres"), F.lit(1.0).alias("yres"), width.cast("int").alias("width"), F.lit(60).alias("height")
    )
    return ids.select("district_id", shape.alias("geometry"), grid.alias("grid"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("label").cast("long").alias("district_id"), F.col("vec_id").alias("building_id"), F.col("embedding").cast("array<double>").alias("features")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways; not written, as there are many times more edges than input: for what reads them once."""
    pairs = similarity.linked_pairs(nodes(spark, sf_dir), THRESHOLD)
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return pairs.select("district_id", F.explode(F.array(way("i", "j"), way("j", "i"))).alias("e"), (1 - F.col("cosine")).alias("distance")).select("district_id", "e.src", "e.dst", "distance")


def written_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(edges(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(building_id, y, pred): the class whose mean vector is nearest."""
    n = nodes(spark, sf_dir)
    means = n.select("district_id", F.posexplode("features").alias("k", "v")).groupBy("district_id", "k").agg(F.avg("v").alias("m"))
    # ten classes: one row that holds their mean vectors
    table = means.groupBy(F.col("district_id").alias("c")).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("m")).agg(F.collect_list(F.struct("c", "m")).alias("classes"))
    gap = lambda cls: F.aggregate(F.zip_with("features", cls["m"], lambda x, m: (x - m["m"]) * (x - m["m"])), F.lit(0.0), lambda acc, v: acc + v)
    best = F.array_min(F.transform("classes", lambda cls: F.struct(F.round(gap(cls), 9).alias("d"), cls["c"].alias("c"))))
    return n.join(F.broadcast(table)).select("building_id", F.col("district_id").cast("int").alias("y"), best["c"].cast("int").alias("pred"))
