"""Boxes of shapes in cells of several sizes, and on a space-filling curve.

A box lies in cells of a size that fits it, so that a large shape takes no more of them than a
small one.  Cells hold numbers and boxes; the shapes themselves are read once a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.plans.lineage import cut

#: A box is at most so many cells of its level long and wide.
ACROSS = 4
#: Cell numbers on the curve lie within plus and minus this.
REACH = 1 << 30
#: How far the bits of a number are moved apart, and what is kept then.
SPREADS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def boxed(shapes: DataFrame, key: str, tile: float = 64.0) -> DataFrame:
    """(row, key, geometry, box, level), written, so that rows keep their numbers.  Cells of
    a level are ``tile`` times a power of two wide.  Rows without a geometry are left out."""
    box = F.col("box")
    extent = F.greatest(box["maxx"] - box["minx"], box["maxy"] - box["miny"])
    level = F.greatest(F.lit(0), F.ceil(F.log2(extent / (tile * ACROSS))).cast("int"))
    rows = shapes.select(key, "geometry").where(F.size("geometry") > 0)
    return cut(rows.withColumn("box", G.bounds(F.col("geometry"))).withColumns({"level": level, "row": F.monotonically_increasing_id()}))


def levels_of(boxes: DataFrame) -> list[int]:
    """The levels that occur: a number for each doubling of size, so only a few."""
    return sorted(r["level"] for r in boxes.select("level").distinct().collect())


def cells(boxes: DataFrame, others: list[int], tile: float = 64.0) -> DataFrame:
    """(row, box, level, at, cx, cy): the cells that a box meets at its own level and at
    each higher one of ``others``."""
    at = F.array_distinct(F.concat(F.array("level"), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda k: k > F.col("level"))))
    size = tile * F.pow(F.lit(2.0), F.col("at"))
    along = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    rows = boxes.select("row", "box", "level", F.explode(at).alias("at"))
    return rows.withColumn("cx", along("box.minx", "box.maxx")).withColumn("cy", along("box.miny", "box.maxy"))


def pairs(a: DataFrame, b: DataFrame, tile: float = 64.0) -> DataFrame:
    """(arow, brow) of ``boxed`` rows whose boxes meet, borders included, once each: at the larger one's
    level, in the cell that holds the lower left corner of what the boxes share."""
    named = lambda df, side: df.select(*(F.col(c).alias(side + c) for c in ("row", "box", "level")), "at", "cx", "cy")
    left, right = named(cells(a, levels_of(b), tile), "a"), named(cells(b, levels_of(a), tile), "b")
    size = tile * F.pow(F.lit(2.0), F.col("at"))
    meet = (F.col("at") == F.greatest("alevel", "blevel")) & (F.col("abox.minx") <= F.col("bbox.maxx")) & (F.col("bbox.minx") <= F.col("abox.maxx"))
    meet &= (F.col("abox.miny") <= F.col("bbox.maxy")) & (F.col("bbox.miny") <= F.col("abox.maxy"))
    corner = lambda c: F.floor(F.greatest(F.col(f"abox.{c}"), F.col(f"bbox.{c}")) / size)
    own = (corner("minx") == F.col("cx")) & (corner("miny") == F.col("cy"))
    return left.join(right, ["at", "cx", "cy"]).where(meet & own).select("arow", "brow")


def _apart(v: Column) -> Column:
    for shift, mask in SPREADS:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def curve_key(x: Column, y: Column) -> Column:
    """The place of a cell on a curve that alternates the bits of both numbers."""
    held = lambda v: _apart(F.greatest(F.least(v, F.lit(REACH - 1)), F.lit(-REACH)).cast("long") + REACH)
    return held(x).bitwiseOR(F.shiftleft(held(y), 1))


def laid_out(shapes: DataFrame, cell: float = 64.0) -> DataFrame:
    """``shapes`` with minx, miny, maxx, maxy (null without a geometry), in the order of the curve: files
    written from it hold neighbours, so that a window reads few of them."""
    box = F.when(F.size("geometry") > 0, G.bounds(F.col("geometry")))
    rows = shapes.withColumn("_box", box).withColumns({c: F.col(f"_box.{c}") for c in ("minx", "miny", "maxx", "maxy")}).drop("_box")
    mid = lambda lo, hi: F.floor((F.col(lo) + F.col(hi)) / (2 * cell))
    keyed = rows.withColumn("_curve", curve_key(mid("minx", "maxx"), mid("miny", "maxy")))
    return keyed.repartitionByRange("_curve").sortWithinPartitions("_curve").drop("_curve")


def in_window(laid: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """The rows whose box meets a window, borders included; the comparisons reach the files' statistics."""
    return laid.where((F.col("minx") <= maxx) & (F.col("maxx") >= minx) & (F.col("miny") <= maxy) & (F.col("maxy") >= miny))
