"""Raster operators over cells ``(district_id, row, col, label)``.

No row means outside the district; label 0 is free, -999 not reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.functions import kernels as K
from terrafold.operators import rings
from terrafold.plans.lineage import cut

ROUNDS, NODATA = 30, -999
#: Districts up to this many cells grow in one task each; larger ones cell by cell over the cluster.
KERNEL_CELLS = 4_000_000
CELL = "district_id long, row int, col int, label long"
GRID = {"x0": "double", "y1": "double", "xres": "double", "yres": "double", "width": "int", "height": "int"}
#: The eight neighbours.
OFFSETS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def grid(bounds: Column, resolution: float = 1.0, buffer: float = 10.0) -> Column:
    """struct<x0, y1, xres, yres, width, height>: bounds with a buffer, cells
    rounded up in number; row 0 is the north edge."""
    w, h = bounds["maxx"] - bounds["minx"] + 2 * buffer, bounds["maxy"] - bounds["miny"] + 2 * buffer
    width, height = F.ceil(w / resolution).cast("int"), F.ceil(h / resolution).cast("int")
    return F.struct(
        (bounds["minx"] - buffer).alias("x0"),
        (bounds["maxy"] + buffer).alias("y1"),
        (w / width).alias("xres"),
        (h / height).alias("yres"),
        width.alias("width"),
        height.alias("height"),
    )


def cell_centre(g: Column, row: Column, col: Column) -> Column:
    return F.struct((g["x0"] + (col + 0.5) * g["xres"]).alias("x"), (g["y1"] - (row + 0.5) * g["yres"]).alias("y"))


def _points(geometry: pa.ListArray) -> tuple[np.ndarray, ...]:
    """x, y, ring and shape of each point, and the shape of each ring."""
    parts = geometry.flatten()
    rings = parts.flatten()
    owner = pc.list_parent_indices(geometry).take(pc.list_parent_indices(parts)).to_numpy()
    ring = pc.list_parent_indices(rings).to_numpy()
    x, y = (c.to_numpy(zero_copy_only=False) for c in rings.flatten().flatten())
    return x, y, ring, owner[ring], owner


#: Rows of the raster that a task holds before it passes them on.
LINES = 1 << 17


def _covered_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of covered cells of shapes with a ``geometry`` and a ``grid``, the last two columns."""
    for batch in batches:
        keyed = batch.select(batch.schema.names[:-2])
        for of, row, first, last in _runs(batch.column("geometry"), batch.column("grid")):
            runs = [pa.array(c.astype(np.int32)) for c in (row, first, last)]
            yield pa.RecordBatch.from_arrays([*keyed.take(pa.array(of)).columns, *runs], names=[*keyed.schema.names, "row", "first", "last"])


def _runs(geometry: pa.ListArray, grid: pa.StructArray) -> Iterator[tuple[np.ndarray, ...]]:
    """(place of the shape, row, first and last column) of runs."""
    x, y, ring, shape, owner = _points(geometry)
    if not len(x):
        return
    at = np.flatnonzero(np.r_[True, shape[1:] != shape[:-1]])
    of = shape[at]
    x0, y1, xres, yres, width, height = (c.to_numpy(zero_copy_only=False)[of] for c in grid.flatten())
    minx, miny, maxx, maxy = np.minimum.reduceat(x, at), np.minimum.reduceat(y, at), np.maximum.reduceat(x, at), np.maximum.reduceat(y, at)
    # first and last cell whose inside the bounds meet
    clamp = lambda v, top: np.clip(v, 0, top - 1)
    span = lambda lo, hi, step, n: (clamp(np.floor(lo / step), n), np.maximum(clamp(np.floor(lo / step), n), clamp(np.ceil(hi / step) - 1, n)))
    near = (maxx >= x0) & (minx <= x0 + width * xres) & (miny <= y1) & (maxy >= y1 - height * yres)
    spans = [np.where(near, v, 0).astype(np.int64) for v in (*span(y1 - maxy, y1 - miny, yres, height), *span(minx - x0, maxx - x0, xres, width))]
    r0, r1, c0, c1 = spans
    # a shape of one ring that fills its bounds needs no test of its cells
    dx, dy = x - np.repeat(x[at], np.diff(np.r_[at, len(x)])), y - np.repeat(y[at], np.diff(np.r_[at, len(x)]))
    cross = np.r_[np.where(ring[1:] == ring[:-1], dx[:-1] * dy[1:] - dx[1:] * dy[:-1], 0), 0]
    fills = (np.bincount(owner, minlength=len(geometry))[of] == 1) & (np.abs(np.abs(np.add.reduceat(cross, at)) / 2 - (maxx - minx) * (maxy - miny)) < 1e-9)

    full = np.flatnonzero(near & fills)
    lines = np.cumsum(r1[full] - r0[full] + 1)
    for some in np.split(full, np.flatnonzero(np.diff(lines // LINES)) + 1):
        n = r1[some] - r0[some] + 1
        which = np.repeat(some, n)
        yield of[which], r0[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), c0[which], c1[which]

    ends = np.r_[at, len(x)]
    for k in np.flatnonzero(near & ~fills):
        points = np.stack([x[ends[k] : ends[k + 1]], y[ends[k] : ends[k + 1]]], 1)
        same = np.flatnonzero(ring[ends[k] : ends[k + 1] - 1] == ring[ends[k] + 1 : ends[k + 1]])
        segments = np.stack([points[same], points[same + 1]], 1)
        left = lambda c: x0[k] + c * xres[k]  # noqa: E731, B023
        found = []
        for r in range(r0[k], r1[k] + 1):
            top = y1[k] - r * yres[k]
            cols = np.arange(c0[k], c1[k] + 1)
            cols = cols[K.meet_open_boxes(segments, left(cols), left(cols) + xres[k], top - yres[k], top)]
            if len(cols):
                new = np.flatnonzero(np.diff(cols) > 1)
                first, last = cols[np.r_[0, new + 1]], cols[np.r_[new, len(cols) - 1]]
                found.append((np.full(len(first), of[k]), np.full(len(first), r), first, last))
        if found:
            yield tuple(np.concatenate(c) for c in zip(*found, strict=True))


def covered_rows(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, first, last): for each row of the raster the runs of columns of the cells
    whose inside the geometry meets; ``shapes`` has keys, ``geometry`` and ``grid``.  A kernel,
    as all these tests in one expression make the driver plan, compile and keep many times as much."""
    held = shapes.where((F.size("geometry") > 0) & F.col("grid").isNotNull()).select(*keys, "geometry", F.struct(*(F.col(f"grid.{c}").cast(kind).alias(c) for c, kind in GRID.items())).alias("grid"))
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in held.select(*keys).dtypes)
    return held.mapInArrow(_covered_kernel, f"{kinds}, row int, first int, last int")


def covered_cells(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col) of the cells whose inside the geometry meets."""
    return covered_rows(shapes, keys).select(*keys, "row", F.explode(F.sequence("first", "last")).alias("col"))


def burn(buildings: DataFrame, districts: DataFrame) -> DataFrame:
    """Cells of the districts with the id of the building on them (0: free).

    ``districts`` has district_id, geometry, grid; ``buildings`` district_id,
    building_id, geometry and ``position`` (on overlap the last one wins).  Ids of
    0 or less leave their cells free.  Only rows of shapes are exchanged: their cells
    meet in the partition of their row.
    """
    mask = covered_rows(districts, ["district_id"]).select("district_id", "row", "first", "last", F.lit(True).alias("inside"), F.lit(None).cast("long").alias("position"), F.lit(None).cast("long").alias("building_id"))
    placed = buildings.where(F.col("building_id") > 0).join(districts.select("district_id", "grid").hint("merge"), "district_id")
    lines = covered_rows(placed, ["district_id", "building_id", "position"]).select("district_id", "row", "first", "last", F.lit(False).alias("inside"), F.col("position").cast("long"), "building_id")
    # a number of its own: rows of shapes are small before their cells come, and few partitions would be left
    n = int(mask.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = mask.unionByName(lines).repartition(n, "district_id", "row").withColumn("col", F.explode(F.sequence("first", "last")))
    # without a position comes before any
    found = each.groupBy("district_id", "row", "col").agg(F.max(F.struct("position", "building_id")).alias("top"), F.max("inside").alias("inside"))
    return found.where("inside").select("district_id", "row", "col", F.coalesce("top.building_id", F.lit(0)).cast("long").alias("label"))


def rejected_ids(buildings: DataFrame) -> DataFrame:
    """Buildings whose id can't be burnt, with the reason."""
    return buildings.where(~(F.col("building_id") > 0)).select("building_id", F.lit("id is not positive").alias("error"))


def _dense(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    r0, c0 = int(group["row"].min()), int(group["col"].min())
    shape = (int(group["row"].max()) - r0 + 1, int(group["col"].max()) - c0 + 1)
    labels, mask = np.zeros(shape, np.int64), np.zeros(shape, bool)
    at = group["row"].to_numpy() - r0, group["col"].to_numpy() - c0
    labels[at], mask[at] = group["label"].to_numpy(), True
    return labels, mask, r0, c0


def _framed(group: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], int, int]:
    """Labels and mask with one cell of frame, the cells' places in them, and the raster's place of their corner."""
    row, col = group["row"].to_numpy(), group["col"].to_numpy()
    r0, c0 = int(row.min()) - 1, int(col.min()) - 1
    at = row - r0, col - c0
    labels = np.zeros((int(at[0].max()) + 2, int(at[1].max()) + 2), np.int64)
    mask = np.zeros(labels.shape, bool)
    labels[at], mask[at] = group["label"].to_numpy(), True
    return labels, mask, at, r0, c0


def _grow_kernel(rounds: int):
    def run(group: pa.Table) -> pa.Table:
        labels, mask, at, _, _ = _framed(group)
        grown = K.grow(labels, mask, rounds)[at]
        if grown.max() > 0:
            grown[grown == 0] = NODATA
        return pa.table({"district_id": group["district_id"], "row": group["row"], "col": group["col"], "label": grown})

    return run


def grow_by_joins(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Growth for rasters of any size: each round the frontier tells its label to
    its neighbours, and a free cell takes the largest."""
    known = cut(cells.select("district_id", "row", "col", "label"))
    frontier = known.where(F.col("label") > 0)
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in OFFSETS])
    for _ in range(rounds):
        told = (
            frontier.withColumn("s", F.explode(steps))
            .select("district_id", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), F.col("label").alias("heard"))
            .groupBy("district_id", "row", "col")
            .agg(F.max("heard").alias("heard"))
        )
        step = cut(
            known.join(told.hint("merge"), ["district_id", "row", "col"], "left").select(
                "district_id", "row", "col", F.when(F.col("label") == 0, F.coalesce("heard", F.lit(0))).otherwise(F.col("label")).alias("label"), ((F.col("label") == 0) & (F.col("heard") > 0)).alias("new")
            )
        )
        known, frontier = step.drop("new"), step.where("new").drop("new")
        if frontier.limit(1).count() == 0:
            break
    return known


def grow(cells: DataFrame, rounds: int = ROUNDS, kernel_cells: int = KERNEL_CELLS) -> DataFrame:
    """Voronoi cells: labels grown for so many rounds, the rest -999.  A district
    without any label stays 0 throughout."""
    cells = cut(cells)
    sizes = cells.groupBy("district_id").agg(F.count("*").alias("n"), F.max("label").alias("top"))
    large = cut(sizes.where(F.col("n") > kernel_cells).select("district_id", "top"))
    run = lambda small: small.groupBy("district_id").applyInArrow(_grow_kernel(rounds), CELL)
    if not large.limit(1).count():
        return run(cells)
    by_joins = grow_by_joins(cells.join(large.select("district_id"), "district_id", "left_semi"), rounds).join(large, "district_id")
    label = F.when((F.col("label") == 0) & (F.col("top") > 0), F.lit(NODATA)).otherwise(F.col("label"))
    return run(cells.join(large, "district_id", "left_anti")).unionByName(by_joins.select("district_id", "row", "col", label.cast("long").alias("label")))


def region_areas(cells: DataFrame, cell_area: float = 1.0) -> DataFrame:
    return cells.where(F.col("label") > 0).groupBy("district_id", F.col("label").alias("building_id")).agg(
        F.count("*").alias("n_cells"), (F.count("*") * F.lit(cell_area)).alias("area")
    )


def coverage(cells: DataFrame) -> DataFrame:
    return cells.groupBy("district_id").agg(
        F.count("*").alias("n_cells"), F.count_if(F.col("label") > 0).alias("n_building_cells"), F.avg((F.col("label") > 0).cast("double")).alias("share")
    )


EDGE = "district_id long, row int, col int, label long, sure boolean, gaps array<int>"


def _edge_kernel(group: pa.Table) -> pa.Table:
    """Own cells whose window holds two labels (``sure``), or whose window has places
    without a cell (``gaps``, as numbers in OFFSETS)."""
    labels, mask, at, _, _ = _framed(group)
    own = group["own"].to_numpy(zero_copy_only=False)
    r, c = at[0][own], at[1][own]
    label = labels[r, c]
    there = np.stack([mask[r + dr, c + dc] for dr, dc in OFFSETS], 1)
    other = np.stack([labels[r + dr, c + dc] != label for dr, dc in OFFSETS], 1)
    sure, gap = (there & other).any(1), ~there
    told = sure | gap.any(1)
    gap[sure] = False
    ends = np.r_[0, gap[told].sum(1).cumsum()].astype(np.int32)
    gaps = pa.ListArray.from_arrays(ends, np.nonzero(gap[told])[1].astype(np.int32))
    of = group.filter(pa.array(own)).filter(pa.array(told))
    return pa.table({"district_id": of["district_id"], "row": of["row"], "col": of["col"], "label": of["label"], "sure": sure[told], "gaps": gaps})


def boundary_cells(cells: DataFrame, buildings: DataFrame | None = None, tile: int = rings.TILE) -> DataFrame:
    """(district_id, row, col) whose 3 x 3 window holds different labels.  Cells
    outside the district count as -999; at the edge of the raster the window
    repeats its own edge cells.  Cells of ``buildings`` are left out.  Windows are
    taken by tiles with a halo of one cell."""
    seen = rings.tiled(cells, tile).groupBy("district_id", "tr", "tc").applyInArrow(_edge_kernel, EDGE)
    box = cells.groupBy("district_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    # a place without a cell inside the raster is -999, one beside it repeats a cell of the window
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in OFFSETS])
    place = lambda k: (F.col("row") + F.get(steps, k)["dr"], F.col("col") + F.get(steps, k)["dc"])
    inside = lambda r, c: r.between(F.col("r0"), F.col("r1")) & c.between(F.col("c0"), F.col("c1"))
    maybe = seen.join(box.hint("merge"), "district_id").where(F.col("sure") | (F.col("label") != NODATA) & F.exists("gaps", lambda k: inside(*place(k))))
    out = maybe.select("district_id", "row", "col")
    if buildings is not None:
        taken = buildings.where(F.col("label") > 0).select("district_id", "row", "col")
        out = out.join(taken.hint("merge"), ["district_id", "row", "col"], "left_anti")
    return out


def thin_boundaries(boundary: DataFrame) -> DataFrame:
    """Boundary cells reduced to lines one cell wide."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        _, mask, r0, c0 = _dense(group.assign(label=1))
        rows, cols = np.nonzero(K.thin(mask))
        return pd.DataFrame({"district_id": group["district_id"].iloc[0], "row": (rows + r0).astype("int32"), "col": (cols + c0).astype("int32")})

    return boundary.groupBy("district_id").applyInPandas(run, "district_id long, row int, col int")


def boundary_lines(thin: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Lines traced along thin cells, simplified and merged where two meet."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        _, mask, r0, c0 = _dense(group.assign(label=1))
        lines = K.merge_lines(K.simplify_all([x.astype(float) for x in K.trace_lines(mask)], tolerance))
        rows = [[{"x": float(c + c0 + 0.5), "y": float(r + r0 + 0.5)} for r, c in x] for x in lines if len(x) > 1]
        return pd.DataFrame({"district_id": group["district_id"].iloc[0], "line_id": range(len(rows)), "points": rows}) if rows else pd.DataFrame({"district_id": [], "line_id": [], "points": []})

    lines = thin.groupBy("district_id").applyInPandas(run, "district_id long, line_id int, points array<struct<x:double,y:double>>")
    return measured(lines)


def measured(lines: DataFrame) -> DataFrame:
    """Lines with their ``length``, without those that have none."""
    return lines.withColumn("length", G.line_length(F.col("points"))).where((F.size("points") >= 2) & (F.col("length") > 0))


@F.pandas_udf(G.GEOMETRY_TYPE.elementType.elementType)
def _simplified(points: pd.Series, tolerance: pd.Series) -> pd.Series:
    return pd.Series([[{"x": x, "y": y} for x, y in K.simplify(np.array([(p["x"], p["y"]) for p in ring]), t).tolist()] for ring, t in zip(points, tolerance, strict=True)])


def region_polygons(cells: DataFrame, tolerance: float = 0.0, tile: int = rings.TILE) -> DataFrame:
    """(district_id, building_id, geometry, area): the exterior ring, in cell
    corners, of each 4-connected component; an id may have several.  Rings are
    traced by tiles, so a district of any size takes many tasks."""
    return polygons_of(rings.region_rings(cells, tile).where("area > 0"), tolerance)


def polygons_of(outer: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(district_id, building_id, geometry, area) of exterior rings."""
    # from the leftmost, then topmost corner on, and closed
    start = F.array_position("points", F.array_min("points")).cast("int")
    ring = F.concat(F.slice("points", start, F.size("points")), F.slice("points", F.lit(1), start))
    closed = outer.select("district_id", F.col("label").alias("building_id"), ring.alias("ring"))
    if tolerance:
        closed = closed.withColumn("ring", _simplified("ring", F.lit(float(tolerance))))
    return closed.select("district_id", "building_id", F.array(F.array("ring")).cast(G.GEOMETRY).alias("geometry")).withColumn("area", G.area(F.col("geometry")))


def segment_polygons(cells: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(district_id, label, geometry, area): a geometry a label, of the (disjoint)
    exteriors of all its components in the order of their corners."""
    each = region_polygons(cells, tolerance)
    parts = F.flatten(F.array_sort(F.collect_list("geometry")))
    return each.groupBy("district_id", F.col("building_id").alias("label")).agg(parts.alias("geometry")).withColumn("area", G.area(F.col("geometry")))


def placed(polygons: DataFrame, grids: DataFrame) -> DataFrame:
    """Geometries in cell corners as places of their district's grid."""
    g = F.col("grid")
    point = lambda p: G.point(g["x0"] + p["x"] * g["xres"], g["y1"] - p["y"] * g["yres"])
    moved = F.transform("geometry", lambda part: F.transform(part, lambda ring: F.transform(ring, point)))
    return polygons.join(grids.select("district_id", "grid"), "district_id").withColumn("geometry", moved).withColumn("area", G.area(F.col("geometry"))).drop("grid")


def label_colours(labels: DataFrame, seed: int = 42) -> DataFrame:
    """(label, red, green, blue): the same colour for a label in every run; 0 and below are grey."""
    part = lambda k: F.when(F.col("label") > 0, F.pmod(F.xxhash64("label", F.lit(seed + k)), F.lit(206)) + 50).otherwise(200).cast("int")
    return labels.select("label").distinct().select("label", part(0).alias("red"), part(1).alias("green"), part(2).alias("blue"))


def enclosures(cells: DataFrame) -> DataFrame:
    """(district_id, src, dst): regions whose cells lie within another's filled exterior."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        labels, _, _, _ = _dense(group)
        parts, out = K.components4(labels), set()
        at = K.components_at(parts)
        lo, hi = (np.array([[getattr(side, end) for side in part] for _, part in at]) for end in ("start", "stop"))
        for k, part in at:
            # what lies in a hole has its own window well within
            if not ((lo > [s.start for s in part]) & (hi < [s.stop for s in part])).all(1).any():
                continue
            own = parts[part] == k
            holes = K.filled(own) & ~own
            if holes.any():
                a = int(labels[part][own][0])
                out |= {(min(a, int(b)), max(a, int(b))) for b in np.unique(labels[part][holes]) if b > 0 and b != a}
        return pd.DataFrame([(int(group["district_id"].iloc[0]), a, b) for a, b in sorted(out)], columns=["district_id", "src", "dst"])

    return cells.where(F.col("label") > 0).groupBy("district_id").applyInPandas(run, "district_id long, src long, dst long")
