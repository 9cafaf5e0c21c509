"""Districts as strips of a sheet: the shapes of a district come to one task, as its cells
do to grow, and many districts are burnt, grown and read at once.  No cell is a row, so
none is exchanged or written.  Strips have an empty row between them and an empty column
at both sides, so that nothing passes from one to another.  Districts whose grid has more
than ``KERNEL_CELLS`` cells take the tables of cells, by joins and tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import kernels as K
from terrafold.operators import adjacency, raster, rings
from terrafold.operators.adjacency import HALF
from terrafold.operators.raster import GRID, KERNEL_CELLS, NODATA, ROUNDS, _runs
from terrafold.operators.rings import RING, TILE, closed
from terrafold.plans.lineage import cut

#: Cells of a sheet, unless one district needs more.
SHEET = 1 << 19


@dataclass
class Sheet:
    """Strips by their district, first row in the sheet, size and place in the district's
    raster.  Cells hold numbers of labels (0: free), in the order of ``names``."""

    ids: np.ndarray
    first: np.ndarray
    height: np.ndarray
    width: np.ndarray
    r0: np.ndarray
    c0: np.ndarray
    strip: np.ndarray  # of each row
    names: np.ndarray
    burnt: np.ndarray
    labels: np.ndarray
    mask: np.ndarray


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts: the place of each item's owner, and its number there."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def whole_districts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of their districts, as tables that hold whole districts."""
    # (kernels name functions of other modules, not the modules: those travel with all that they hold)
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch["district_id"].to_numpy()
        if held and held[-1]["district_id"][0].as_py() != ids[-1]:
            last = int(np.searchsorted(ids, ids[-1]))
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held, batch = [], batch.slice(last)
        elif not held and ids[0] != ids[-1]:
            last = int(np.searchsorted(ids, ids[-1]))
            yield pa.Table.from_batches([batch.slice(0, last)]).combine_chunks()
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name]
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def drawn(table: pa.Table, rounds: int) -> Iterator[Sheet]:
    """The sheets of whole districts, burnt as ``raster.burn`` does it, and grown."""
    d, is_frame = table["district_id"].to_numpy(), table["is_frame"].to_numpy()
    geometry, grid = _column(table, "geometry"), _column(table, "grid")
    full = pc.fill_null(pc.greater(pc.list_value_length(geometry), 0), False).to_numpy(zero_copy_only=False)
    building = pc.fill_null(_column(table, "building_id"), 0).to_numpy()
    frames = np.flatnonzero(is_frame & full & grid.is_valid().to_numpy(zero_copy_only=False))
    shapes = np.flatnonzero(~is_frame & full & (building > 0))
    lo = np.searchsorted(d[frames], d[shapes])
    of, k = _spread(np.searchsorted(d[frames], d[shapes], "right") - lo)
    shapes, grids = shapes[of], frames[lo[of] + k]
    taken = np.r_[frames, shapes]
    found = list(_runs(geometry.take(pa.array(taken)), grid.take(pa.array(np.r_[frames, grids]))))
    if not found:
        return
    of, row, first, last = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))
    inside = of < len(frames)
    ids, at = np.unique(d[taken[of]], return_inverse=True)
    box = np.full((4, len(ids)), np.iinfo(np.int64).max)
    for side, v in zip(box, (row, -row, first, -last), strict=True):
        np.minimum.at(side, at[inside], v[inside])
    r0, r1, c0, c1 = box[0], -box[1], box[2], -box[3]
    kept = np.flatnonzero(r1 >= r0)
    # the last of a place wins: those without a position first, then by position and id
    rows = taken[of]
    position = _column(table, "position")
    placed, order = position.is_valid().to_numpy(zero_copy_only=False)[rows], pc.fill_null(position, 0).to_numpy()[rows]
    by = np.lexsort((building[rows], order, placed))
    of, row, first, last, inside, at, rows = (v[by] for v in (of, row, first, last, inside, at, rows))
    first, last = np.maximum(first, c0[at]), np.minimum(last, c1[at])
    held = (row >= r0[at]) & (row <= r1[at]) & (first <= last)

    def sheet(strips: np.ndarray) -> Sheet:
        height, width = r1[strips] - r0[strips] + 1, c1[strips] - c0[strips] + 1
        start = np.cumsum(height + 1) - height
        shape = int(start[-1] + height[-1] + 1), int(width.max()) + 2
        number = np.full(len(ids), -1)
        number[strips] = np.arange(len(strips))
        some = np.flatnonzero(held & (number[at] >= 0))
        s = number[at[some]]
        r, a, b = row[some] - r0[at[some]] + start[s], first[some] - c0[at[some]] + 1, last[some] - c0[at[some]] + 1
        own = inside[some]
        # runs begin and end
        edge = np.bincount(r[own] * shape[1] + a[own], minlength=shape[0] * shape[1]) - np.bincount(r[own] * shape[1] + b[own] + 1, minlength=shape[0] * shape[1])
        mask = (np.cumsum(edge) > 0).reshape(shape)
        r, a, b = r[~own], a[~own], b[~own]
        names, number = np.unique(building[rows[some[~own]]], return_inverse=True)
        run, k = _spread(b - a + 1)
        burnt = np.zeros(shape, np.int32)
        burnt.ravel()[(r * shape[1] + a)[run] + k] = (number + 1)[run]
        burnt[~mask] = 0
        strip = np.repeat(np.arange(len(strips)), height + 1)
        return Sheet(ids[strips], start, height, width, r0[strips], c0[strips], np.r_[0, strip], np.r_[0, names].astype(np.int64), burnt, K.grow(burnt, mask, rounds), mask)

    strips: list[int] = []
    tall, wide = 1, 0
    for k in kept.tolist():
        h, w = int(r1[k] - r0[k]) + 2, int(c1[k] - c0[k]) + 3
        if strips and (tall + h) * max(wide, w) > SHEET:
            yield sheet(np.array(strips))
            strips, tall, wide = [], 1, 0
        strips.append(k)
        tall, wide = tall + h, max(wide, w)
    if strips:
        yield sheet(np.array(strips))


def dealt(buildings: DataFrame, districts: DataFrame) -> DataFrame:
    """Districts and their buildings, those of a district one after another in one partition."""
    grid = F.struct(*(F.col(f"grid.{c}").cast(kind).alias(c) for c, kind in GRID.items()))
    kind = ", ".join(f"{c}:{k}" for c, k in GRID.items())
    none = lambda type_: F.lit(None).cast(type_)
    frames = districts.select("district_id", none("long").alias("building_id"), none("long").alias("position"), F.lit(True).alias("is_frame"), "geometry", F.when(F.col("grid").isNotNull(), grid).alias("grid"))
    shapes = buildings.select("district_id", F.col("building_id").cast("long").alias("building_id"), F.col("position").cast("long").alias("position"), F.lit(False).alias("is_frame"), "geometry", none(f"struct<{kind}>").alias("grid"))
    n = int(districts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = frames.unionByName(shapes).where("district_id is not null").withColumn("district_id", F.col("district_id").cast("long"))
    return both.repartition(n, "district_id").sortWithinPartitions("district_id")


Kernel = Callable[[pa.Table, Sheet], pa.RecordBatch | None]


def read(buildings: DataFrame, districts: DataFrame, kernel: Kernel, schema: str, rounds: int = ROUNDS) -> DataFrame:
    """What ``kernel`` makes of the shapes and each of their sheets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_districts(batches):
            for sheet in drawn(table, rounds):
                out = kernel(table, sheet)
                if out is not None and out.num_rows:
                    yield out

    return dealt(buildings, districts).mapInArrow(run, schema)


def by_size(
    buildings: DataFrame, districts: DataFrame, small: Callable[[DataFrame, DataFrame], DataFrame], large: Callable[[DataFrame, DataFrame], DataFrame], kernel_cells: int = KERNEL_CELLS
) -> DataFrame:
    """``small`` of the districts whose grids fit a task, and ``large`` of the others."""
    cells = districts.groupBy("district_id").agg(F.sum(F.col("grid.width").cast("long") * F.col("grid.height")).alias("n"))
    over = cut(cells.where(F.col("n") > kernel_cells).select("district_id"))
    if not over.limit(1).count():
        return small(buildings, districts)
    of = lambda how: (df.join(over.hint("merge"), "district_id", how) for df in (buildings, districts))
    return small(*of("left_anti")).unionByName(large(*of("left_semi")))


def _grown(buildings: DataFrame, districts: DataFrame) -> DataFrame:
    return cut(raster.grow(raster.burn(buildings, districts)))


# Rings


def _list(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def _ring_kernel(table: pa.Table, sheet: Sheet) -> pa.RecordBatch | None:
    found = closed(sheet.labels)
    if found is None:
        return None
    ring, row, label, area, x, y = found
    s = sheet.strip[row]
    n = np.bincount(ring, minlength=len(row))
    x, y = x - 1 + sheet.c0[s][ring], y + (sheet.r0 - sheet.first)[s][ring]
    points = _list(pa.StructArray.from_arrays([pa.array(v.astype(float)) for v in (x, y)], ["x", "y"]), n)
    return pa.RecordBatch.from_pydict({"district_id": sheet.ids[s], "label": sheet.names[label], "area": area, "points": points})


def region_rings(buildings: DataFrame, districts: DataFrame, tile: int = TILE, kernel_cells: int = KERNEL_CELLS) -> DataFrame:
    """``rings.region_rings`` of the grown labels; ``tile`` is that of districts which don't fit a task."""

    def small(b: DataFrame, d: DataFrame) -> DataFrame:
        return read(b, d, _ring_kernel, RING)

    return by_size(buildings, districts, small, lambda b, d: rings.region_rings(_grown(b, d), tile), kernel_cells)


def region_polygons(buildings: DataFrame, districts: DataFrame) -> DataFrame:
    """``raster.region_polygons`` of the grown labels."""
    return raster.polygons_of(region_rings(buildings, districts).where("area > 0"))


# Adjacency


def _touching(sheet: Sheet) -> tuple[np.ndarray, ...]:
    """(strip, src < dst) of numbers of labels on neighbouring cells, once each."""
    flat, width = sheet.labels.ravel(), sheet.labels.shape[1]
    some = np.flatnonzero(flat)
    met = []
    for dr, dc in HALF:
        a, b = flat[some], flat[some + dr * width + dc]
        k = np.flatnonzero((b > 0) & (a != b))
        met.append((sheet.strip[some[k] // width], np.minimum(a[k], b[k]), np.maximum(a[k], b[k])))
    return tuple(map(np.concatenate, zip(*met, strict=True)))


def _holed(parts: np.ndarray) -> np.ndarray:
    """Numbers of the 4-connected components with a hole, by the Euler number of their windows of 2 x 2."""
    n = int(parts.max()) + 1
    a, b, c, d = w = parts[:-1, :-1], parts[:-1, 1:], parts[1:, 1:], parts[1:, :-1]
    total = np.zeros(n)
    for k in range(4):
        p, q, r, s = (w[(k + i) % 4] for i in range(4))
        q, r, s = p == q, p == r, p == s
        same = q.view(np.uint8) + r.view(np.uint8) + s.view(np.uint8)
        # one of a window counts 1, three count -1 together, two on a diagonal -2
        for kind, value in ((same == 0, 1.0), (same == 2, -1 / 3), ((same == 1) & r, -1.0)):
            total += value * np.bincount(p[kind], minlength=n)
    return np.flatnonzero(np.round(total / 4)[1:] < 1) + 1


def _enclosed(sheet: Sheet) -> list[tuple[int, int, int]]:
    """(strip, src < dst) of numbers of labels of which one lies in a hole of the other."""
    parts, out = K.components4(sheet.labels), set()
    holed = _holed(parts) if parts.any() else []
    if not len(holed):
        return []
    places = dict(K.components_at(parts))
    for k in holed.tolist():
        own = parts[places[k]] == k
        labels = sheet.labels[places[k]]
        a, strip = int(labels[own][0]), int(sheet.strip[places[k][0].start])
        out |= {(strip, min(a, int(b)), max(a, int(b))) for b in np.unique(labels[K.filled(own) & ~own]) if b > 0 and b != a}
    return sorted(out)


def _edge_kernel(holes: bool):
    def run(table: pa.Table, sheet: Sheet) -> pa.RecordBatch | None:
        found = _touching(sheet)
        if holes and (inner := _enclosed(sheet)):
            found = tuple(np.r_[v, w] for v, w in zip(found, zip(*inner, strict=True), strict=True))
        n = len(sheet.names)
        key = np.unique((found[0].astype(np.int64) * n + found[1]) * n + found[2])
        strip, src, dst = key // (n * n), sheet.names[key // n % n], sheet.names[key % n]
        # shapes by district and id; more than one may have the same
        rows = np.flatnonzero(~table["is_frame"].to_numpy() & pc.is_valid(_column(table, "building_id")).to_numpy(zero_copy_only=False))
        rows = rows[np.isin(table["district_id"].to_numpy()[rows], sheet.ids)]
        d, own = table["district_id"].to_numpy()[rows], pc.fill_null(_column(table, "building_id"), 0).to_numpy()[rows]
        ids = np.unique(own)
        keys = np.searchsorted(sheet.ids, d) * len(ids) + np.searchsorted(ids, own)
        order = np.argsort(keys, kind="stable")

        def shapes(at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            wanted = at * len(ids) + np.searchsorted(ids, of)
            lo = np.searchsorted(keys[order], wanted)
            pair, k = _spread(np.searchsorted(keys[order], wanted, "right") - lo)
            return pair, order[lo[pair] + k]

        pair, i = shapes(strip, src)
        strip, src, dst = strip[pair], src[pair], dst[pair]
        pair, j = shapes(strip, dst)
        strip, src, dst, i = strip[pair], src[pair], dst[pair], i[pair]
        if not len(src):
            return None
        distance = K.distances(_column(table, "geometry").take(pa.array(rows)), i, j)
        both = lambda a, b: np.stack([a, b], 1).ravel()
        return pa.RecordBatch.from_pydict({"district_id": np.repeat(sheet.ids[strip], 2), "src": both(src, dst), "dst": both(dst, src), "distance": np.repeat(distance, 2)})

    return run


def adjacency_edges(buildings: DataFrame, districts: DataFrame, holes: bool = True, kernel_cells: int = KERNEL_CELLS) -> DataFrame:
    """``adjacency.adjacency_edges`` of ``adjacency.touching_regions`` of the grown labels."""

    def small(b: DataFrame, d: DataFrame) -> DataFrame:
        return read(b, d, _edge_kernel(holes), "district_id long, src long, dst long, distance double")

    def large(b: DataFrame, d: DataFrame) -> DataFrame:
        return adjacency.adjacency_edges(adjacency.touching_regions(_grown(b, d), holes), b)

    return by_size(buildings, districts, small, large, kernel_cells)


# Boundaries


def _boundary(sheet: Sheet) -> np.ndarray:
    """Cells without a building whose window holds different labels, as ``raster.boundary_cells`` has them."""
    some = np.zeros(len(sheet.ids), bool)
    some[sheet.strip[(sheet.labels > 0).any(1)]] = True
    # as there, what isn't reached is as what lies outside; without any label it is free
    value = np.where(sheet.mask, np.where(sheet.labels > 0, sheet.labels, np.where(some, -1, 0)[sheet.strip][:, None]), -1)
    within = np.zeros(sheet.mask.shape, bool)
    for first, h, w in zip(sheet.first, sheet.height, sheet.width, strict=True):
        within[first : first + h, 1 : 1 + w] = True

    def window(v: np.ndarray, pick) -> np.ndarray:
        v = np.pad(v, 1, mode="edge")
        v = pick(pick(v[:, :-2], v[:, 1:-1]), v[:, 2:])
        return pick(pick(v[:-2], v[1:-1]), v[2:])

    top, low = window(np.where(within, value, -2), np.maximum), window(np.where(within, value, np.iinfo(np.int32).max), np.minimum)
    return sheet.mask & (top != low) & (sheet.burnt == 0)


def _line_kernel(tolerance: float):
    def run(table: pa.Table, sheet: Sheet) -> pa.RecordBatch | None:
        thin = K.thin(_boundary(sheet))
        cells = np.stack(np.nonzero(thin))
        if not cells.size:
            return None
        origin = np.full((len(sheet.ids), 2), max(thin.shape))
        np.minimum.at(origin, sheet.strip[cells[0]], cells.T)
        # rows go strip by strip, and so do lines; equal distances are told as in the strip alone
        lines = K.trace_lines(thin)
        origins = [origin[sheet.strip[x[0][0]]] for x in lines]
        simple = K.simplify_all([(x - o).astype(float) for x, o in zip(lines, origins, strict=True)], tolerance)
        lines = K.merge_lines([x + o for x, o in zip(simple, origins, strict=True)])
        lines = [x for x in lines if len(x) > 1]
        if not lines:
            return None
        n = np.array([len(x) for x in lines])
        points, strip = np.concatenate(lines), sheet.strip[[int(x[0][0]) for x in lines]]
        of = np.repeat(strip, n)
        x, y = points[:, 1] - 1 + sheet.c0[of] + 0.5, points[:, 0] + (sheet.r0 - sheet.first)[of] + 0.5
        number = np.arange(len(n)) - np.searchsorted(strip, strip)
        shape = _list(pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]), n)
        return pa.RecordBatch.from_pydict({"district_id": sheet.ids[strip], "line_id": number.astype(np.int32), "points": shape})

    return run


def boundary_lines(buildings: DataFrame, districts: DataFrame, tolerance: float = 0.5, kernel_cells: int = KERNEL_CELLS) -> DataFrame:
    """``raster.boundary_lines`` of the thin boundaries of the grown labels."""

    def small(b: DataFrame, d: DataFrame) -> DataFrame:
        return raster.measured(read(b, d, _line_kernel(tolerance), "district_id long, line_id int, points array<struct<x:double,y:double>>"))

    def large(b: DataFrame, d: DataFrame) -> DataFrame:
        burnt = cut(raster.burn(b, d))
        return raster.boundary_lines(raster.thin_boundaries(raster.boundary_cells(cut(raster.grow(burnt)), burnt)), tolerance)

    return by_size(buildings, districts, small, large, kernel_cells)
