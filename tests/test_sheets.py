"""Districts read on sheets against their tables of cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import adjacency, raster, rings, sheets

GRID = "struct<x0:double,y1:double,xres:double,yres:double,width:int,height:int>"


def box(x0, y0, x1, y1):
    return [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]]


def drawn(spark):
    """Districts of several shapes: a box, a slanted one, one without buildings, one with a ring
    around others, and buildings that lie over each other, beside their district or without one."""
    rng = np.random.default_rng(5)
    districts = [(1, box(0.0, 0.0, 20.0, 12.0), (0.0, 12.0, 1.0, 1.0, 20, 12))]
    districts.append((2, [[[(0.0, 0.0), (25.0, 4.0), (21.0, 18.0), (3.0, 11.0), (0.0, 0.0)]]], (-2.0, 20.0, 1.0, 1.0, 30, 24)))
    districts.append((3, box(0.0, 0.0, 5.0, 5.0), (0.0, 5.0, 1.0, 1.0, 5, 5)))
    districts.append((4, box(0.0, 0.0, 30.0, 30.0), (-1.0, 31.0, 1.0, 1.0, 32, 32)))
    # a building around a yard with two buildings in it
    ring = [[*box(3.0, 3.0, 20.0, 20.0)[0], [(6.0, 6.0), (17.0, 6.0), (17.0, 17.0), (6.0, 17.0), (6.0, 6.0)]]]
    buildings = [(4, 1, 0, ring), (4, 2, 1, box(8.0, 8.0, 10.0, 11.0)), (4, 3, 2, box(13.0, 9.0, 15.0, 12.0)), (4, 4, 3, box(24.0, 24.0, 28.0, 27.0))]
    for d in (1, 2):
        for i in range(9):
            x, y = rng.integers(-3, 22), rng.integers(-3, 12)
            buildings.append((d, 10 * d + i, int(rng.integers(0, 4)), box(float(x), float(y), float(x + rng.integers(1, 5)), float(y + rng.integers(1, 5)))))
    buildings += [(1, 0, 50, box(1.0, 1.0, 4.0, 4.0)), (1, 99, None, box(2.0, 2.0, 9.0, 9.0)), (9, 5, 0, box(0.0, 0.0, 3.0, 3.0)), (2, 77, 3, [[[(5.0, 5.0), (11.0, 6.0), (7.0, 10.0), (5.0, 5.0)]]])]
    return (
        spark.createDataFrame(buildings, f"district_id long, building_id long, position long, geometry {G.GEOMETRY}"),
        spark.createDataFrame(districts, f"district_id long, geometry {G.GEOMETRY}, grid {GRID}"),
    )


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("sheet", [1, 900, 1 << 19])
def test_cells_of_sheets(spark, sheet, monkeypatch):
    monkeypatch.setattr(sheets, "SHEET", sheet)
    buildings, districts = drawn(spark)
    got = []
    for table in sheets.whole_districts(iter(sheets.dealt(buildings, districts).coalesce(1).sortWithinPartitions("district_id").toArrow().to_batches(7))):
        for s in sheets.drawn(table, 4):
            r, c = np.nonzero(s.mask)
            k = s.strip[r]
            got += zip(s.ids[k].tolist(), (r - s.first[k] + s.r0[k]).tolist(), (c - 1 + s.c0[k]).tolist(), s.names[s.labels[r, c]].tolist(), strict=True)
    want = raster.grow(raster.burn(buildings, districts), 4).withColumn("label", F.greatest("label", F.lit(0)))
    assert sorted(got) == sorted(map(tuple, want.collect()))


def outline(df):
    return sorted((r.district_id, r.label, r.area, tuple(sorted((p.x, p.y) for p in r.points))) for r in df.collect())


@pytest.mark.parametrize("kernel_cells", [0, 500, 1 << 22])
def test_rings_without_cells(spark, kernel_cells):
    buildings, districts = drawn(spark)
    got = outline(sheets.region_rings(buildings, districts, tile=5, kernel_cells=kernel_cells))
    assert got == outline(rings.region_rings(raster.grow(raster.burn(buildings, districts)), 5))
    assert any(area < 0 for _, _, area, _ in got)


def test_rings_make_no_table_of_cells(spark):
    from terrafold.plans.catalogue import QUERIES

    plan = QUERIES["region_rings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "FlatMapGroupsIn" not in plan and "explode" not in plan


@pytest.mark.parametrize("kernel_cells", [500, 1 << 22])
def test_edges_without_cells(spark, kernel_cells, monkeypatch):
    monkeypatch.setattr(sheets, "SHEET", 2000)
    buildings, districts = drawn(spark)
    got = rows(sheets.adjacency_edges(buildings, districts, kernel_cells=kernel_cells), "district_id", "src", "dst", F.round("distance", 9))
    cells = raster.grow(raster.burn(buildings, districts))
    want = rows(adjacency.adjacency_edges(adjacency.touching_regions(cells), buildings), "district_id", "src", "dst", F.round("distance", 9))
    assert got == want
    # what lies in the yard meets the building around it and nothing else does it with what lies outside
    assert {(1, 2), (1, 3), (2, 3), (1, 4)} == {(r[1], r[2]) for r in got if r[0] == 4 and r[1] < r[2]}


@pytest.mark.parametrize("kernel_cells", [500, 1 << 22])
def test_lines_without_cells(spark, kernel_cells, monkeypatch):
    monkeypatch.setattr(sheets, "SHEET", 2000)
    buildings, districts = drawn(spark)
    got = rows(sheets.boundary_lines(buildings, districts, kernel_cells=kernel_cells), "district_id", "line_id", "points", "length")
    burnt = raster.burn(buildings, districts)
    want = rows(raster.boundary_lines(raster.thin_boundaries(raster.boundary_cells(raster.grow(burnt), burnt))), "district_id", "line_id", "points", "length")
    assert got == want and len({r[0] for r in got}) == 3


def test_holes_without_touching():
    labels = np.zeros((9, 9), np.int32)
    labels[1:8, 1:8] = 1
    labels[2:7, 2:7] = 0
    labels[4, 4] = 2
    one = np.ones(1, int)
    sheet = sheets.Sheet(one, one, 7 * one, 7 * one, 0 * one, 0 * one, np.zeros(9, int), np.array([0, 1, 2]), labels, labels, labels > 0)
    assert sheets._enclosed(sheet) == [(0, 1, 2)]
    labels[1, 4] = 0
    assert sheets._enclosed(sheet) == []


@pytest.mark.parametrize("name", ["adjacency_stats", "voronoi_polygons", "adjacency_faults", "voronoi_adjacency", "voronoi_boundary_lines"])
def test_no_table_of_cells(spark, name):
    from terrafold.plans import lineage
    from terrafold.plans.catalogue import QUERIES

    written = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lineage, "_passing", [written])
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert all("col" not in spark.read.parquet(path).columns for path in written)
