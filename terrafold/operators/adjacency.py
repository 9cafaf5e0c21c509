"""Region adjacency and the distances of the footprints behind it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators.raster import _framed, enclosures
from terrafold.operators.rings import TILE, tiled
from terrafold.operators.spatial import shortest_distance

#: Half of the neighbourhood: each pair of cells meets once.
HALF = [(0, 1), (1, -1), (1, 0), (1, 1)]


def _touching(group: pa.Table) -> pa.Table:
    labels, _, (r, c), _, _ = _framed(group)
    a = np.tile(labels[r, c], len(HALF))
    b = np.concatenate([labels[r + dr, c + dc] for dr, dc in HALF])
    met = (b > 0) & (a != b)
    src, dst = np.minimum(a, b)[met], np.maximum(a, b)[met]
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    first = np.r_[True, (np.diff(src) != 0) | (np.diff(dst) != 0)][: len(src)]
    src, dst = src[first], dst[first]
    return pa.table({"district_id": pa.array(np.full(len(src), group["district_id"][0].as_py())), "src": src, "dst": dst})


def touching_regions(cells: DataFrame, holes: bool = True, tile: int = TILE) -> DataFrame:
    """(district_id, src < dst): labels on neighbouring cells, corners included,
    and regions inside another's hole.  Neighbours are found by tiles with a halo."""
    pairs = tiled(cells.where(F.col("label") > 0), tile).groupBy("district_id", "tr", "tc").applyInArrow(_touching, "district_id long, src long, dst long").distinct()
    return pairs.unionByName(enclosures(cells)).distinct() if holes else pairs


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def adjacency_edges(pairs: DataFrame, buildings: DataFrame) -> DataFrame:
    """Symmetric edges (district_id, src, dst, distance) between footprints of
    adjacent regions; ids without a footprint are left out.  A distance of 0
    stays an edge: ``distance > 0`` gives the matrix view."""
    shape = lambda name: buildings.select("district_id", F.col("building_id").alias(name), F.col("geometry").alias(f"{name}_shape"))
    # a merge: tables of shapes are far larger than their files, by which Spark would send them through the driver
    joined = pairs.join(shape("src").hint("merge"), ["district_id", "src"]).join(shape("dst").hint("merge"), ["district_id", "dst"])
    found = joined.select("district_id", "src", "dst", shortest_distance("src_shape", "dst_shape").alias("distance"))
    # not a union of both ways, which would find the pairs twice
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return found.select("district_id", F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("e"), "distance").select("district_id", "e.src", "e.dst", "distance")


def missing_footprints(pairs: DataFrame, buildings: DataFrame) -> DataFrame:
    ids = pairs.select("district_id", F.explode(F.array("src", "dst")).alias("building_id")).distinct()
    return ids.join(buildings, ["district_id", "building_id"], "left_anti")


def adjacency_stats(edges: DataFrame) -> DataFrame:
    """Per district: edges once each, and min, max, mean of positive distances."""
    positive = F.when(F.col("distance") > 0, F.col("distance"))
    return edges.groupBy("district_id").agg(
        F.floor(F.count(positive) / 2).cast("long").alias("n_edges"),
        F.min(positive).alias("min_distance"),
        F.max(positive).alias("max_distance"),
        F.avg(positive).alias("mean_distance"),
    )


def adjacency_faults(edges: DataFrame) -> DataFrame:
    """Edges that break a property: no self edges, symmetric, not negative."""
    back = edges.select("district_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("distance").alias("back"))
    both = edges.join(back.hint("merge"), ["district_id", "src", "dst"], "left")
    fault = (
        F.when((F.col("src") == F.col("dst")) & (F.col("distance") != 0), "self edge")
        .when(F.col("distance") < 0, "negative")
        .when(F.col("back").isNull() | (F.abs(F.col("back") - F.col("distance")) > 1e-9), "not symmetric")
    )
    return both.select("district_id", "src", "dst", fault.alias("fault")).where(F.col("fault").isNotNull())
