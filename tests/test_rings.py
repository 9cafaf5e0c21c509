"""Rings traced by tiles against the tracing of whole districts; the loader."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.functions import kernels as K
from terrafold.operators import raster, rings
from terrafold.plans import pipeline
from terrafold.sources import tables


def cells_of(spark, grids):
    rows = [(d, r, c, int(g[r, c])) for d, g in grids.items() for r in range(g.shape[0]) for c in range(g.shape[1]) if g[r, c] != -1]
    return spark.createDataFrame(rows, raster.CELL)


def plain_polygons(grids):
    """Exteriors of whole districts in one go."""
    out = []
    for d, g in grids.items():
        parts = K.components4(np.maximum(g, 0))
        for k, at in K.components_at(parts):
            own = parts[at] == k
            ring = [(x + at[1].start, y + at[0].start) for x, y in K.trace_exterior(own)]
            out.append((d, int(g[at][own][0]), tuple(ring)))
    return sorted(out)


NESTED = np.ones((11, 11), int)
for k in (1, 2, 3, 4):
    NESTED[k:-k, k:-k] = k % 3 + 1  # rings in rings


@pytest.mark.parametrize("tile", [3, 4, 64])
def test_polygons_equal_whole_districts(spark, tile):
    rng = np.random.default_rng(tile)
    grids = {1: NESTED, 2: rng.integers(0, 3, (13, 17)), 3: rng.integers(1, 3, (9, 9)), 4: np.ones((1, 1), int), 5: np.array([[1, 0], [0, 1]])}
    got = raster.region_polygons(cells_of(spark, grids), tile=tile).collect()
    key = lambda ring: tuple((int(p.x), int(p.y)) for p in ring)
    mine, want = sorted((r.district_id, r.building_id, key(r.geometry[0][0])) for r in got), plain_polygons(grids)
    assert [(d, b) for d, b, _ in mine] == [(d, b) for d, b, _ in want]
    area = lambda ring: K.polygon_area(np.array(ring[:-1], float))
    # where a ring touches itself both orders of its parts are the same outline
    assert sorted((d, b, area(r), frozenset(r)) for d, b, r in mine) == sorted((d, b, area(r), frozenset(r)) for d, b, r in want)
    assert all(r[0] == r[-1] == min(r) for _, _, r in mine)


def test_rings_with_holes(spark):
    found = rings.region_rings(cells_of(spark, {1: NESTED}), 4).collect()
    assert sorted((r.label, r.area) for r in found) == sorted([(1, 121), (1, -81), (2, 81), (2, -49), (3, 49), (3, -25), (1, 25), (1, -9), (2, 9)])
    assert all(len(r.points) == 4 for r in found)


def test_simplified(spark):
    stairs = np.tril(np.ones((6, 6), int))
    got = raster.region_polygons(cells_of(spark, {1: stairs}), tolerance=1.0).first()
    assert len(got.geometry[0][0]) < 7


def test_no_cells(spark):
    assert raster.region_polygons(cells_of(spark, {1: np.zeros((3, 3), int)})).collect() == []


def shapes(spark, rows, columns):
    return spark.createDataFrame(rows, f"geometry {G.GEOMETRY}, row_pos long, {columns}")


SQUARE = [[[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]]]


def test_text_ids_and_labels(spark):
    rows = [(SQUARE, 0, "A-12", "residential"), (SQUARE, 1, "7", "3"), (SQUARE, 2, None, "4.0"), (SQUARE, 3, " ", None), (SQUARE, 4, "NaN", "NaN"), (SQUARE, 5, "A-12", "9")]
    got = tables.load_shapes(shapes(spark, rows, "FID string, type string"), "building_id").orderBy("row_pos").collect()
    ids = [r.building_id for r in got]
    assert ids[1:5] == [7, 3, 4, 5] and ids[0] == ids[5] > 0
    assert [r.label for r in got] == [None, 3, 4, None, None, 9]
    number = tables.load_shapes(shapes(spark, [(SQUARE, 0, 2.0, 5)], "id double, class long"), "building_id").first()
    assert (number.building_id, number.label) == (2, 5)


def test_rows_without_geometry_are_reported(spark):
    load = lambda rows, key: tables.load_shapes(shapes(spark, rows, "FID long, label long"), key)
    out = pipeline.extract(load([(SQUARE, 0, 1, 0), (None, 1, 2, 0)], "district_id"), load([(SQUARE, 0, 5, 1), (None, 1, 6, 1), ([], 2, 7, 1)], "building_id"), buffer=1.0)
    failed = {(r.district_id, r.building_id, r.error) for r in out["failed"].collect()}
    assert failed == {(2, None, "no geometry"), (None, 6, "no geometry"), (None, 7, "no geometry")}
    assert [r.district_id for r in out["missing"].collect()] == [2]
    assert out["buildings"].agg(F.count("*")).first()[0] == 1
