"""Rings of regions, traced by tiles.

A cell's side is a directed edge where the neighbour there has another label; the
region lies on its right.  Which edge follows is known from the cells ahead: the
same cell's next side, the next cell's same side, or the diagonal cell's last
side (cells that only touch at a corner aren't joined).  A tile with a halo of one
cell links its own edges to pieces; pieces find their ring and their place in it
by doubling over tiles.  Where a region touches itself at a corner, it encloses what
lies between, and the ring is split there.  A ring is the exterior of a 4-connected
component where its area is positive, else a hole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.plans.lineage import cut

#: Side of a tile in cells.
TILE = 512
#: Sides top, right, bottom, left: where the neighbour lies, where the edge leads, its end as seen from the cell's corner.
OUT = [(-1, 0), (0, 1), (1, 0), (0, -1)]
AHEAD = [(0, 1), (1, 0), (0, -1), (-1, 0)]
END = [(0, 1), (1, 1), (1, 0), (0, 0)]
PIECE = "district_id long, label long, key long, next long, area long, xs array<int>, ys array<int>"


def _key(row: np.ndarray, col: np.ndarray, side: np.ndarray) -> np.ndarray:
    return (row.astype(np.int64) << 32) + (col.astype(np.int64) << 2) + side


def _linked(labels: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges of own cells (row, column, side, label), the edge that follows each (row, column,
    side), and whether that is of an own cell."""

    def same(r: np.ndarray, c: np.ndarray, label: np.ndarray) -> np.ndarray:
        return labels[r, c] == label

    edges, follows, mine = [], [], []
    r, c = np.nonzero(own & (labels > 0))
    label = labels[r, c]
    for side in range(4):
        open_ = ~same(r + OUT[side][0], c + OUT[side][1], label)
        er, ec, el = r[open_], c[open_], label[open_]
        ar, ac = er + AHEAD[side][0], ec + AHEAD[side][1]
        ahead = same(ar, ac, el)
        dr, dc = np.where(ahead, ar + OUT[side][0], er), np.where(ahead, ac + OUT[side][1], ec)
        inner = ahead & same(dr, dc, el)
        nr, nc = np.where(inner, dr, np.where(ahead, ar, er)), np.where(inner, dc, np.where(ahead, ac, ec))
        turn = np.where(inner, side - 1, np.where(ahead, side, side + 1)) % 4
        edges.append(np.stack([er, ec, np.full(len(er), side), el]))
        follows.append(np.stack([nr, nc, turn]))
        mine.append(own[nr, nc])
    return (*np.hstack(edges), *np.hstack(follows), np.hstack(mine))


def closed(labels: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """All rings of a framed array: (ring of each point; row of a cell, label and area of each ring;
    x and y of the points, from the array's corner), split where they pass a corner twice."""
    er, ec, side, el, nr, nc, turn, _ = _linked(labels, np.ones(labels.shape, bool))
    if not len(er):
        return None
    key = _key(er, ec, side)
    order = np.argsort(key)
    place = np.searchsorted(key[order], _key(nr, nc, turn)[order]).tolist()
    seen, chain, starts = bytearray(len(place)), [], []
    for start in range(len(place)):
        if seen[start]:
            continue
        starts.append(len(chain))
        at = start
        while not seen[at]:
            seen[at] = 1
            chain.append(at)
            at = place[at]
    starts = np.array(starts)
    by = order[chain]
    er, ec, side, el, turn = (v[by] for v in (er, ec, side, el, turn))
    row, label = er[starts], el[starts]
    area = np.add.reduceat(np.where(side == 1, ec + 1, 0) - np.where(side == 3, ec, 0), starts)
    corner = side != turn
    ends = np.array(END)[side[corner]]
    ring = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(by)]))[corner]
    x, y = ec[corner] + ends[:, 1], er[corner] + ends[:, 0]
    spot = (ring * (labels.shape[0] + 1) + y) * (labels.shape[1] + 1) + x
    spots, times = np.unique(spot, return_counts=True)
    twice = np.zeros(len(starts), bool)
    twice[spots[times > 1] // ((labels.shape[0] + 1) * (labels.shape[1] + 1))] = True
    if twice.any():
        parts = [(k, loop) for k in np.flatnonzero(twice).tolist() for loop in _loops(zip(x[ring == k].tolist(), y[ring == k].tolist(), strict=True))]
        once = ~twice[ring]
        number = np.cumsum(~twice) - 1
        of = np.array([k for k, _ in parts])
        ring = np.r_[number[ring[once]], np.repeat((~twice).sum() + np.arange(len(parts)), [len(loop) for _, loop in parts])]
        x, y = (np.r_[v[once], [p[i] for _, loop in parts for p in loop]] for i, v in enumerate((x, y)))
        row, label, area = np.r_[row[~twice], row[of]], np.r_[label[~twice], label[of]], np.r_[area[~twice], [_area(loop) for _, loop in parts]]
    return ring, row, label, area, x, y


def _pieces(group: pd.DataFrame) -> pd.DataFrame:
    r0, c0 = int(group["row"].min()) - 1, int(group["col"].min()) - 1
    row, col = group["row"].to_numpy() - r0, group["col"].to_numpy() - c0
    labels = np.zeros((row.max() + 2, col.max() + 2), np.int64)
    own = np.zeros(labels.shape, bool)
    labels[row, col] = group["label"].to_numpy()
    own[row, col] = group["own"].to_numpy()
    er, ec, side, el, nr, nc, turn, mine = _linked(labels, own)
    mine = mine.astype(bool)
    key, then = _key(er + r0, ec + c0, side), _key(nr + r0, nc + c0, turn)
    order = np.argsort(key)
    key, then, mine, er, ec, side, el, turn = (x[order] for x in (key, then, mine, er, ec, side, el, turn))
    place = np.searchsorted(key, then)
    place[~mine] = -1
    first = np.ones(len(key), bool)
    first[place[mine]] = False
    area = np.where(side == 1, ec + c0 + 1, 0) - np.where(side == 3, ec + c0, 0)
    ends = np.array(END)[side]
    x, y, corner = ec + c0 + ends[:, 1], er + r0 + ends[:, 0], side != turn
    seen, out, steps = np.zeros(len(key), bool), [], place.tolist()
    # pieces that another tile leads to, then what is closed within the tile
    for start in [*np.flatnonzero(first).tolist(), *range(len(key))]:
        if seen[start]:
            continue
        chain, at = [], start
        while at >= 0 and not seen[at]:
            seen[at] = True
            chain.append(at)
            at = steps[at]
        turns = np.array(chain)[corner[chain]]
        out.append((int(group["district_id"].iloc[0]), int(el[start]), int(key[start]), None if at >= 0 else int(then[chain[-1]]), int(area[chain].sum()), x[turns], y[turns]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")]).astype({"next": "Int64"})


def tiled(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Cells with their tile (``tr``, ``tc``), and once more, not ``own``, for each tile within one cell of them."""
    at = lambda c, d=0: F.floor((F.col(c) + d) / tile)

    def tiles(c: str) -> Column:
        # nearly all cells have one tile
        edge = (F.pmod(F.col(c), F.lit(tile)) == 0) | (F.pmod(F.col(c) + 1, F.lit(tile)) == 0)
        return F.explode(F.when(edge, F.array_distinct(F.array(at(c, -1), at(c), at(c, 1)))).otherwise(F.array(at(c))))

    own = (F.floor(F.col("row") / tile) == F.col("tr")) & (F.floor(F.col("col") / tile) == F.col("tc"))
    return cells.select("district_id", "row", "col", "label").withColumn("tr", tiles("row")).withColumn("tc", tiles("col")).withColumn("own", own)


def ring_pieces(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Pieces of rings (columns PIECE); ``next`` is null where a ring is closed within its tile."""
    return tiled(cells.where(F.col("label") > 0), tile).groupBy("district_id", "tr", "tc").applyInPandas(_pieces, PIECE)


RING = "district_id long, label long, area long, points array<struct<x:double,y:double>>"


def _loops(points: Iterable[tuple]) -> list[list[tuple]]:
    """A ring cut at the corners that it passes twice."""
    way: list[tuple] = []
    at: dict[tuple, int] = {}
    loops = []
    for point in points:
        if point in at:
            since = at[point]
            loops.append(way[since:])
            for gone in way[since + 1 :]:
                del at[gone]
            del way[since + 1 :]
        else:
            at[point] = len(way)
            way.append(point)
    return [*loops, way]


def _area(loop: list[tuple]) -> int:
    x, y = np.array(loop).T
    return int(round((x * (np.roll(y, -1) - np.roll(y, 1))).sum() / 2))


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rings cut at the corners that they pass twice."""
    for rows in batches:
        out = []
        for row in rows.itertuples():
            for loop in _loops((p["x"], p["y"]) for p in row.points):
                out.append((row.district_id, row.label, _area(loop), [{"x": a, "y": b} for a, b in loop]))
        if out:
            yield pd.DataFrame(out, columns=["district_id", "label", "area", "points"])


def region_rings(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """(district_id, label, area, points): every ring of every region, corners only,
    not closed; the area of holes is negative."""
    pieces = cut(ring_pieces(cells, tile))
    closed = pieces.where("next is null").select("district_id", "label", "area", "xs", "ys")
    links = cut(pieces.where("next is not null").select("district_id", "key", "next", F.least("key", "next").alias("low")))
    rings = closed
    if links.limit(1).count():
        # the least key of the ring: after a round without change no piece knows a greater one
        told = links
        while True:
            ahead = told.select("district_id", F.col("key").alias("next"), F.col("next").alias("after"), F.col("low").alias("heard"))
            step = cut(told.join(ahead, ["district_id", "next"]).select("district_id", "key", F.col("after").alias("next"), F.least("low", "heard").alias("low"), (F.col("heard") < F.col("low")).alias("news")))
            told = step.drop("news")
            if not step.where("news").limit(1).count():
                break
        # pieces from each one to the last of its ring
        ranked = cut(links.drop("low").join(told.select("district_id", "key", "low"), ["district_id", "key"]).select("district_id", "key", "low", F.when(F.col("next") != F.col("low"), F.col("next")).alias("next"), F.lit(1).alias("left")))
        while ranked.where("next is not null").limit(1).count():
            ahead = ranked.select("district_id", F.col("key").alias("next"), F.col("next").alias("after"), F.col("left").alias("more"))
            ranked = cut(ranked.join(ahead, ["district_id", "next"], "left").select("district_id", "key", "low", F.col("after").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
        parts = pieces.join(ranked.select("district_id", "key", "low", "left"), ["district_id", "key"])
        in_order = parts.groupBy("district_id", "label", "low").agg(F.sum("area").alias("area"), F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), "xs", "ys"))).alias("e"))
        rings = rings.unionByName(in_order.select("district_id", "label", "area", F.flatten("e.xs").alias("xs"), F.flatten("e.ys").alias("ys")))
    rings = rings.select("district_id", "label", "area", F.arrays_zip(F.col("xs").cast("array<double>").alias("x"), F.col("ys").cast("array<double>").alias("y")).alias("points"))
    touching = F.size(F.array_distinct("points")) < F.size("points")
    rings = cut(rings)
    return rings.where(~touching).unionByName(rings.where(touching).mapInPandas(_split, RING))
