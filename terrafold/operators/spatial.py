"""Spatial joins by cells: an equi-join on cell numbers, then exact tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions import geometry as G
from terrafold.functions import kernels as K
from terrafold.operators import curve
from terrafold.plans.lineage import cut


def candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tile: float = 64.0) -> DataFrame:
    """Pairs whose bounds meet, once each, with ``a`` and ``b`` geometries: boxes are
    joined by cells that fit their sizes, and shapes are fetched for pairs only."""
    a, b = curve.boxed(left, left_id, tile), curve.boxed(right, right_id, tile)
    named = lambda df, side, key: df.select(F.col("row").alias(f"{side}row"), key, F.col("geometry").alias(side))
    return curve.pairs(a, b, tile).join(named(a, "a", left_id), "arow").join(named(b, "b", right_id), "brow").select(left_id, right_id, "a", "b")


@F.pandas_udf(T.DoubleType())
def shortest_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([K.polygon_distance(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(G.GEOMETRY_TYPE)
def clip(geometry: pd.Series, to: pd.Series) -> pd.Series:
    return pd.Series([K.clip_geometry(g, t) for g, t in zip(geometry, to, strict=True)])


@F.pandas_udf(G.GEOMETRY_TYPE)
def repair(geometry: pd.Series) -> pd.Series:
    """Valid geometries of the same area; those without area become null."""
    return pd.Series([K.repair_geometry(g) if g is not None else None for g in geometry])


@F.pandas_udf(G.GEOMETRY_TYPE)
def union_of(geometries: pd.Series) -> pd.Series:
    return pd.Series([K.dissolve(list(g)) for g in geometries])


def faulty(shapes: DataFrame, key: str) -> DataFrame:
    """(key, error) of geometries that no operator can take."""
    flat = F.flatten(F.flatten("geometry"))
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    error = (
        F.when(F.col("geometry").isNull() | (F.size("geometry") == 0), "no geometry")
        .when(F.exists(F.flatten("geometry"), lambda r: F.size(r) < 4), "a ring has less than four points")
        .when(~F.forall(flat, lambda p: number(p["x"]) & number(p["y"])), "a coordinate is no number")
    )
    return shapes.select(key, error.alias("error")).where(F.col("error").isNotNull())


def cluster_geometry(members: DataFrame, cluster: str = "spectral_cluster", fan_in: int = 64) -> DataFrame:
    """(district_id, cluster, geometry, n): the union of a cluster's geometries.  Unions
    are taken of at most ``fan_in`` neighbours (by position along the lower left corner)
    at a time, level by level, so that no task holds a whole cluster's shapes."""
    key = ["district_id", cluster]
    box = G.bounds(F.col("geometry"))
    rows = members.select(*key, "geometry", box["minx"].alias("x"), F.lit(1).cast("long").alias("n"))
    while True:
        place = F.row_number().over(Window.partitionBy(*key).orderBy("x")) - 1
        grouped = rows.withColumn("g", F.floor(place / fan_in)).groupBy(*key, "g").agg(F.collect_list("geometry").alias("all"), F.min("x").alias("x"), F.sum("n").alias("n"))
        rows = cut(grouped.select(*key, union_of("all").alias("geometry"), "x", "n"))
        if rows.groupBy(*key).count().where("count > 1").limit(1).count() == 0:
            return rows.select(*key, "geometry", "n")


def first_geometry(shapes: DataFrame, key: str = "district_id") -> DataFrame:
    """(key, geometry) of the first row of each key."""
    return shapes.groupBy(key).agg(F.min_by("geometry", "row_pos").alias("geometry"))


def within_districts(buildings: DataFrame, districts: DataFrame, tile: float = 64.0) -> DataFrame:
    """(district_id, building_id) of buildings that meet a district; several districts are possible."""
    pairs = candidates(buildings, districts, "building_id", "district_id", tile)
    return pairs.where(shortest_distance("a", "b") == 0).select("district_id", "building_id")


def clip_to_districts(buildings: DataFrame, districts: DataFrame, tile: float = 64.0) -> DataFrame:
    """(district_id, building_id, geometry) clipped; empty results are dropped."""
    pairs = candidates(buildings, districts, "building_id", "district_id", tile)
    return pairs.select("district_id", "building_id", clip("a", "b").alias("geometry")).where(F.col("geometry").isNotNull())


def count_in_segments(segments: DataFrame, buildings: DataFrame, tile: float = 64.0) -> DataFrame:
    """(segment_id, n_buildings) with 0 for segments that meet none."""
    pairs = candidates(segments, buildings, "segment_id", "building_id", tile).where(shortest_distance("a", "b") == 0)
    counts = pairs.groupBy("segment_id").agg(F.count("*").alias("n"))
    return segments.select("segment_id").join(counts, "segment_id", "left").select("segment_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_buildings"))


def merge_segments(tables: list[DataFrame], renumber: bool = True) -> DataFrame | None:
    """Tables on top of each other; ``segment_id`` becomes 1.. in the order of
    table and old id.  Numbers are cut per table and added up, not taken over one
    global window."""
    if not tables:
        return None
    both = [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)]
    out = both[0]
    for t in both[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    if renumber:
        keyed = out.withColumn("_key", F.struct("_table", "segment_id"))
        out = numbered(keyed, "_key", "segment_id", 1).drop("_key")
    return out.drop("_table")


def numbered(df: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """``df`` with consecutive numbers in the order of a column: rows are ranged
    into partitions, numbered inside, and shifted by the rows of earlier ones."""
    # written first: ranges taken twice could differ
    ranged = cut(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    shift = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_shift"))  # a row a partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return (
        ranged.withColumn("_own", own)
        .join(F.broadcast(shift), "_part")
        .withColumn(name, (F.col("_own") + F.col("_shift") - 1 + start).cast("long"))
        .drop("_part", "_own", "_shift")
    )
