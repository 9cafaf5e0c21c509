"""Shape features of footprints, and their standardisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions import geometry as G
from terrafold.functions import kernels as K

#: The features in order; the last is read from a column ``floor`` where there is one.
NAMES = [
    "area", "perimeter", "bbox_width", "bbox_height", "compactness", "elongation", "rectangularity",
    "orientation", "convexity", "vertices", "shape_index", "centre_distance", "floor",
]


def hulls(xs: list, ys: list) -> np.ndarray:
    """Orientation and hull area of each row's points.  Rows that go round a strictly convex
    shape once are their own hull and are taken together, by their number of points."""
    out = np.zeros((len(xs), 2))
    sizes = np.array([0 if x is None else len(x) for x in xs])
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        p = np.stack([np.stack([xs[i] for i in at]), np.stack([ys[i] for i in at])], 2).astype(float)
        convex = np.zeros(len(at), bool)
        if n > 2:
            d = np.roll(p, -1, 1) - p
            e = np.roll(d, -1, 1)
            cross, dot = K.cross2(d, e), (d * e).sum(2)
            around = np.abs(np.arctan2(cross, dot).sum(1))
            convex = ((cross > 0).all(1) | (cross < 0).all(1)) & (np.abs(around - 2 * np.pi) < 1e-6)
        if convex.any():
            q, d = p[convex], d[convex]
            u = d / np.hypot(d[..., 0], d[..., 1])[..., None]
            along, across = q @ u.transpose(0, 2, 1), q @ np.stack([-u[..., 1], u[..., 0]], 1)
            w, h = np.ptp(along, 1), np.ptp(across, 1)
            longer = np.where((w >= h)[..., None], u, np.stack([-u[..., 1], u[..., 0]], 2))
            angle = np.abs(np.arctan2(longer[..., 1], longer[..., 0])) % (np.pi / 2)
            angle[np.pi / 2 - angle < 1e-12] = 0.0
            size = np.round(w * h, 9)
            # the least angle of the least rectangles
            out[at[convex], 0] = np.where(size == size.min(1)[:, None], angle, np.inf).min(1)
            out[at[convex], 1] = np.abs(K.cross2(q, np.roll(q, -1, 1)).sum(1)) / 2
        for i, points in zip(at[~convex], p[~convex], strict=True):
            out[i] = K.orientation(points), K.polygon_area(K.convex_hull(points))
    return out


@F.pandas_udf(T.StructType([T.StructField("angle", T.DoubleType()), T.StructField("hull", T.DoubleType())]))
def _hull(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(hulls(xs.to_list(), ys.to_list()), columns=["angle", "hull"])


def _hull_of(geometry: Column) -> Column:
    open_ = F.flatten(F.transform(F.flatten(geometry), lambda ring: F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))))
    return _hull(F.transform(open_, lambda p: p["x"]), F.transform(open_, lambda p: p["y"]))


def building_features(buildings: DataFrame, spatial: bool = True) -> DataFrame:
    """(district_id, building_id, 13 features).  Empty shapes get zeros, NaN and
    infinite values become 0.  ``centre_distance`` is the distance to the middle
    of the district's total bounds over its larger side."""
    shape = F.col("geometry")
    full = F.size(shape) > 0
    b = G.bounds(shape)
    # dealt anew: a small file of many shapes would be one task's
    base = buildings.repartition("district_id", "building_id").withColumns({"box": F.when(full, b), "h": _hull_of(shape)})
    if spatial:
        total = buildings.withColumn("box", F.when(full, b)).groupBy("district_id").agg(*(getattr(F, f)(f"box.{c}").alias(f"t_{c}") for f, c in (("min", "minx"), ("min", "miny"), ("max", "maxx"), ("max", "maxy"))))
        base = base.join(total, "district_id")
    w, h = F.col("box.maxx") - F.col("box.minx"), F.col("box.maxy") - F.col("box.miny")
    base = base.withColumns({"a": F.when(full, G.area(shape)), "p": F.when(full, G.perimeter(shape)), "w": w, "hh": h})
    a, p, w, h = (F.col(c) for c in ("a", "p", "w", "hh"))
    if spatial:
        middle = G.centroid(shape)
        scale = F.greatest(F.col("t_maxx") - F.col("t_minx"), F.col("t_maxy") - F.col("t_miny"))
        away = F.hypot(middle["x"] - (F.col("t_minx") + F.col("t_maxx")) / 2, middle["y"] - (F.col("t_miny") + F.col("t_maxy")) / 2)
        centre = F.when(scale > 0, away / scale).otherwise(0.0)
    else:
        centre = F.lit(0.0)
    values = {
        "area": a,
        "perimeter": p,
        "bbox_width": w,
        "bbox_height": h,
        "compactness": F.when(p > 0, F.least(F.lit(1.0), 4 * F.pi() * a / (p * p))).otherwise(0.0),
        "elongation": F.when(w > 0, h / w).otherwise(1.0),
        "rectangularity": F.when(w * h > 0, a / (w * h)).otherwise(0.0),
        "orientation": F.col("h.angle"),
        "convexity": F.when(F.col("h.hull") > 0, a / F.col("h.hull")).otherwise(1.0),
        "vertices": G.vertex_count(shape).cast("double"),
        "shape_index": F.when(a > 0, p / F.sqrt(a)).otherwise(0.0),
        "centre_distance": centre,
        "floor": F.coalesce(F.col("floor").cast("double"), F.lit(0.0)) if "floor" in buildings.columns else F.lit(0.0),
    }
    clean = lambda v: F.when(~full | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    return base.select("district_id", "building_id", *(clean(v).alias(k) for k, v in values.items()))


def feature_vectors(features: DataFrame, names: list[str] = NAMES) -> DataFrame:
    return features.select("district_id", "building_id", F.array(*names).alias("features"))


#: Deviations up to this are those of equal values.
SAME = 1e-12


def feature_stats(vectors: DataFrame, *keys: str) -> DataFrame:
    """(keys, place, mean, sd): the population deviation, 1 where it is 0.  Equal values have
    one of about 1e-16 where the sums of many tasks meet, which counts as 0."""
    each = vectors.select(*keys, F.posexplode("features").alias("place", "value"))
    sd = F.stddev_pop("value")
    return each.groupBy(*keys, "place").agg(F.avg("value").alias("mean"), F.when(sd > SAME, sd).otherwise(1.0).alias("sd"))


def standardize(vectors: DataFrame, stats: DataFrame) -> DataFrame:
    """Vectors by stats (place, mean, sd) fitted before: one broadcast row."""
    row = stats.agg(F.array_sort(F.collect_list(F.struct("place", "mean", "sd"))).alias("stats"))  # a struct a feature
    scaled = F.zip_with("features", "stats", lambda x, s: (x - s["mean"]) / s["sd"])
    return vectors.join(F.broadcast(row)).withColumn("features", scaled).drop("stats")
