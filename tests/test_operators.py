import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import adjacency, attention, features, graph, metrics, raster, results, similarity, spatial, training


def shapes(spark, name, rows):
    df = spark.createDataFrame([(k, *map(float, box)) for k, *box in rows], f"{name} long, x0 double, y0 double, x1 double, y1 double")
    return df.select(name, G.rectangle(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("geometry"))


def test_geometry(spark):
    hole = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]]]
    row = spark.createDataFrame([(hole,)], f"g {G.GEOMETRY}").select(
        G.area(F.col("g")).alias("a"), G.perimeter(F.col("g")).alias("p"), G.vertex_count(F.col("g")).alias("v"), G.centroid(F.col("g")).alias("c"), G.bounds(F.col("g")).alias("b")
    ).first()
    assert (row.a, row.p, row.v) == (15, 20, 4) and abs(row.c.x - (32 - 1.5) / 15) < 1e-9 and row.b.maxx == 4
    east = spark.range(1).select(G.utm_from_wgs84(F.lit(117.0), F.lit(30.0)).alias("p"), G.utm_from_wgs84(F.lit(118.0), F.lit(30.0)).alias("q")).first()
    assert abs(east.p.x - 500000) < 1e-6 and abs(east.p.y - 3318785.35) < 0.1 and abs(east.q.x - 596450.1) < 1


def test_spatial_joins(spark):
    b = shapes(spark, "building_id", [(1, 0, 0, 2, 2), (2, 9, 9, 12, 12), (3, 50, 50, 51, 51)])
    d = shapes(spark, "district_id", [(7, 0, 0, 10, 10), (8, 10, 10, 20, 20)])
    assert {tuple(r) for r in spatial.within_districts(b, d, 4.0).collect()} == {(7, 1), (7, 2), (8, 2)}
    clipped = spatial.clip_to_districts(b, d, 4.0).select("district_id", "building_id", G.area(F.col("geometry")).alias("a")).collect()
    assert {tuple(r) for r in clipped} == {(7, 1, 4.0), (7, 2, 1.0), (8, 2, 4.0)}
    s = d.withColumnRenamed("district_id", "segment_id").unionByName(shapes(spark, "segment_id", [(9, 90, 90, 91, 91)]))
    assert {tuple(r) for r in spatial.count_in_segments(s, b).collect()} == {(7, 2), (8, 1), (9, 0)}
    assert spatial.merge_segments([]) is None


def cells_of(spark, rows, district=1):
    return spark.createDataFrame([(district, r, c, int(v)) for r, line in enumerate(rows) for c, v in enumerate(line) if v is not None], raster.CELL)


def test_burn(spark):
    grid = F.struct(F.lit(0.0).alias("x0"), F.lit(4.0).alias("y1"), F.lit(1.0).alias("xres"), F.lit(1.0).alias("yres"), F.lit(4).alias("width"), F.lit(4).alias("height"))
    d = shapes(spark, "district_id", [(1, 0, 0, 4, 4)]).withColumn("grid", grid)
    b = shapes(spark, "building_id", [(5, 0, 0, 2, 2), (3, 1, 1, 2.5, 2), (-1, 3, 3, 4, 4)]).withColumns({"district_id": F.lit(1).cast("long"), "position": F.when(F.col("building_id") == 3, 2).otherwise(1)})
    got = {(r.row, r.col): r.label for r in raster.burn(b, d).collect()}
    assert len(got) == 16 and {k for k, v in got.items() if v == 5} == {(2, 0), (3, 0), (3, 1)} and {k for k, v in got.items() if v == 3} == {(2, 1), (2, 2)}
    assert raster.rejected_ids(b).count() == 1


def test_covered_cells_meet_the_geometry(spark):
    """The kernel's cells are those of the expression, for shapes with slopes, holes, parts and places beside the raster."""
    rng = np.random.default_rng(3)
    star = lambda n, x, y, size: [(x + s * math.cos(a), y + s * math.sin(a)) for a, s in zip(np.linspace(0, 2 * math.pi, n, endpoint=False), rng.uniform(0.3, 1, n) * size, strict=True)]
    closed = lambda ring: [tuple(map(float, p)) for p in [*ring, ring[0]]]
    made = [[[closed(star(int(rng.integers(3, 9)), *rng.uniform(-2, 14, 2), rng.uniform(0.2, 5)))] for _ in range(int(rng.integers(1, 3)))] for _ in range(60)]
    square = closed([(1, 1), (9, 1), (9, 9), (1, 9)])
    made += [[[square, closed([(3, 3), (6, 3), (6, 7), (3, 7)])]], [[square]], [[closed([(40, 40), (41, 40), (41, 41)])]], [[]]]
    g = {"x0": 0.0, "y1": 12.0, "xres": 0.75, "yres": 1.0, "width": 14, "height": 12}
    grid = F.struct(*(F.lit(v).alias(k) for k, v in g.items()))
    s = spark.createDataFrame(list(enumerate(made)), f"id long, geometry {G.GEOMETRY}").withColumn("grid", grid)
    got = {tuple(r) for r in raster.covered_cells(s, ["id"]).collect()}
    every = s.where(F.size(G.points(F.col("geometry"))) > 0).join(spark.range(12).select(F.col("id").cast("int").alias("row"))).join(spark.range(14).select(F.col("id").cast("int").alias("col")))
    x, y = F.col("col") * 0.75, 12.0 - F.col("row")
    assert got == {tuple(r) for r in every.where(G.meets_open_box(G.edges(F.col("geometry")), x, y - 1, x + 0.75, y)).select("id", "row", "col").collect()}
    assert {k for k, *_ in got} >= {60, 61} and not {62, 63} & {k for k, *_ in got}


def test_plan_of_covered_cells_is_small(spark):
    grid = F.struct(F.lit(0.0).alias("x0"), F.lit(4.0).alias("y1"), F.lit(1.0).alias("xres"), F.lit(1.0).alias("yres"), F.lit(4).alias("width"), F.lit(4).alias("height"))
    d = shapes(spark, "district_id", [(1, 0, 0, 4, 4)]).withColumn("grid", grid)
    plan = raster.coverage(raster.burn(d.drop("grid").withColumns({"building_id": F.lit(5), "position": F.lit(1)}), d))._jdf.queryExecution().optimizedPlan()
    # arrays of runs, not the arrays of cells and segments that were in the plan itself
    assert len(plan.toString()) < 15_000


def test_cells_are_not_broadcast(spark, capsys):
    """Tables of cells are far larger than Spark expects from the shapes that they come from."""
    grid = F.struct(F.lit(0.0).alias("x0"), F.lit(4.0).alias("y1"), F.lit(1.0).alias("xres"), F.lit(1.0).alias("yres"), F.lit(4).alias("width"), F.lit(4).alias("height"))
    d = shapes(spark, "district_id", [(1, 0, 0, 4, 4)]).withColumn("grid", grid)
    b = shapes(spark, "building_id", [(5, 0, 0, 2, 2)]).withColumns({"district_id": F.lit(1).cast("long"), "position": F.lit(1)})
    burnt = raster.burn(b, d)
    written = raster.cut(burnt)
    for df in (burnt, raster.grow(written), adjacency.touching_regions(written)):
        df.explain()
        assert "Broadcast" not in capsys.readouterr().out
    near = raster.boundary_cells(written, written)
    near.explain()
    assert capsys.readouterr().out.count("BroadcastHashJoin") <= 1  # a row a district
    assert {(r.row, r.col) for r in near.collect()} == {(r, c) for r in range(1, 4) for c in range(3)} - {(r, c) for r in (2, 3) for c in (0, 1)}


def test_shapes_are_not_broadcast(spark, tmp_path, capsys):
    """Shapes take far more room than the files that they come from, and pairs are found once for both ways."""
    b = shapes(spark, "building_id", [(k, 3 * k, 0, 3 * k + 1, 1) for k in range(4)]).withColumn("district_id", F.lit(1).cast("long"))
    b.write.parquet(f"{tmp_path}/b")
    b = spark.read.parquet(f"{tmp_path}/b")
    pairs = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (1, 1, 9)], "district_id long, src long, dst long")
    edges = adjacency.adjacency_edges(pairs, b)
    for df in (edges, adjacency.adjacency_faults(edges)):
        df.explain()
        plan = capsys.readouterr().out
        assert "Broadcast" not in plan
    edges.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    assert sorted(tuple(r) for r in edges.collect()) == [(1, 0, 1, 2.0), (1, 1, 0, 2.0), (1, 1, 3, 5.0), (1, 3, 1, 5.0)]


def test_growth_forms_agree(spark):
    rng = np.random.default_rng(3)
    rows = [[None if rng.random() < 0.2 else int(rng.random() < 0.05) * int(rng.integers(1, 9)) for _ in range(15)] for _ in range(12)]
    cells = cells_of(spark, rows)
    assert {tuple(r) for r in raster.grow(cells, 4).collect()} == {tuple(r) for r in raster.grow(cells, 4, kernel_cells=10).collect()}
    assert {r.label for r in raster.grow(cells_of(spark, [[0, 0]]), 4).collect()} == {0}
    assert sorted(r.label for r in raster.grow(cells_of(spark, [[2] + [0] * 40])).collect())[:10] == [-999] * 10


def test_adjacency_has_corners_and_holes(spark):
    ring = [[1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, 2, 1, 1], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1]]
    corner = [[1, 0, 0], [0, 3, 0], [0, 0, 0]]
    assert [tuple(r) for r in adjacency.touching_regions(cells_of(spark, corner), holes=False).collect()] == [(1, 1, 3)]
    apart = [[1, 1, 1, 1, 1], [1, -999, -999, -999, 1], [1, -999, 2, -999, 1], [1, -999, -999, -999, 1], [1, 1, 1, 1, 1]]
    assert adjacency.touching_regions(cells_of(spark, apart), holes=False).count() == 0
    assert [tuple(r) for r in adjacency.touching_regions(cells_of(spark, apart)).collect()] == [(1, 1, 2)]
    assert [r.area for r in raster.region_polygons(cells_of(spark, ring)).orderBy("building_id").collect()] == [25, 1]
    b = shapes(spark, "building_id", [(1, 0, 0, 1, 1), (2, 1, 0, 2, 1)]).withColumn("district_id", F.lit(1).cast("long"))
    touching = adjacency.adjacency_edges(spark.createDataFrame([(1, 1, 2)], "district_id long, src long, dst long"), b)
    assert [r.distance for r in touching.collect()] == [0, 0]  # an edge all the same
    assert adjacency.adjacency_faults(touching).count() == 0


def test_features(spark):
    b = shapes(spark, "building_id", [(1, 0, 0, 4, 1), (2, 10, 0, 10, 3)]).withColumn("district_id", F.lit(1).cast("long"))
    r = {x.building_id: x for x in features.building_features(b).collect()}
    assert r[1].area == 4 and r[1].elongation == 0.25 and abs(r[1].compactness - 4 * math.pi * 4 / 100) < 1e-12 and r[1].vertices == 4
    assert r[2].elongation == 1 and r[2].area == 0 and r[2].rectangularity == 0
    v = features.feature_vectors(features.building_features(b))
    out = features.standardize(v, features.feature_stats(v)).collect()
    assert all(abs(sum(x.features[k] for x in out)) < 1e-9 for k in range(13))


def test_hulls_together(monkeypatch):
    """Convex shapes are taken in one go, all others as before."""
    rng, k = np.random.default_rng(8), np.arange(5)
    star = [(np.cos(4 * np.pi * i / 5), np.sin(4 * np.pi * i / 5)) for i in k]
    rows = [[(0, 0), (4, 0), (4, 1), (0, 1)], [(0, 1), (4, 1), (4, 0), (0, 0)], [(0, 0), (2, 0), (4, 0), (4, 3), (0, 3)], star, star[::-1], [(0, 0), (3, 1), (1, 4)], [(1, 1)], [(1, 1), (3, 4)], [(0, 0)] * 4]
    rows += [[(0, 0), (5, 1), (1, 1), (0, 4)], *rng.normal(size=(20, 4, 2)).tolist(), *rng.normal(size=(20, 6, 2)).tolist()]
    got = features.hulls([[p[0] for p in r] for r in rows] + [None, []], [[p[1] for p in r] for r in rows] + [None, []])
    want = [(features.K.orientation(p), features.K.polygon_area(features.K.convex_hull(p))) for p in (np.array(r, float) for r in rows)]
    assert np.allclose(got, [*want, (0, 0), (0, 0)], atol=1e-9)
    monkeypatch.setattr(features.K, "convex_hull", None)
    assert features.hulls([[0, 4, 4, 0]] * 3, [[0, 0, 1, 1]] * 3).tolist() == [[0.0, 4.0]] * 3


def test_graph(spark):
    n = spark.createDataFrame([(1, i) for i in range(5)], "district_id long, building_id long")
    e = spark.createDataFrame([(1, 0, 1, 2.0), (1, 1, 0, 2.0), (1, 3, 4, 2.0), (1, 4, 3, 2.0)], "district_id long, src long, dst long, weight double")
    assert [r.component for r in graph.connected_components(n, e).orderBy("building_id").collect()] == [0, 0, 1, 2, 2]
    s = graph.graph_stats(n, e).first()
    assert (s.num_nodes, s.num_edges, s.median_degree, s.isolated, s.density) == (5, 4, 1, 1, 0.2)
    assert {r.w for r in e.select(graph.normalized_weights(e, "minmax").alias("w")).collect()} == {1.0}
    with pytest.raises(ValueError):
        graph.normalized_weights(e, "other")
    assert graph.with_self_loops(e, n).count() == 9 and graph.edges_over(e, 3.0).count() == 0
    assert graph.split(n, "building_id", 0.5).where("is_train").count() == 2


def test_attention_forms_and_gradient(spark):
    rng = np.random.default_rng(0)
    net = attention.Network.random(3, 2, 3, layers=2, heads=2)
    x, links = rng.normal(size=(5, 3)), np.array([(0, 1), (1, 0), (1, 2), (2, 1), (3, 4), (4, 3)])
    n = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "district_id long, building_id long, features array<double>")
    e = spark.createDataFrame([(1, int(a), int(b), float(1 + a)) for a, b in links], "district_id long, src long, dst long, distance double")
    got = np.array([r.logits for r in attention.forward(n, e, net).orderBy("building_id").collect()])
    assert np.allclose(got, attention.forward_numpy(net, x, links)[-1]["z"], atol=1e-9)
    with pytest.raises(ValueError):
        attention.attention_weights(n, e, net.layers[0], 5)
    y, d, at = rng.integers(0, 3, 5), 1.0 + links[:, 0], training.flat(net)
    _, _, grad = training.loss_and_gradient(net, x, links, d, y, 0.5, 2.0)
    for i in rng.choice(len(at), 25, replace=False):
        step = np.zeros_like(at)
        step[i] = 1e-6
        up, down = (training.loss_and_gradient(training.unflat(net, at + s * step), x, links, d, y, 0.5, 2.0)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - grad[i]) < 1e-5


def test_training_lowers_the_loss_and_resumes(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(d, i, (rng.normal(size=4) + 3 * np.eye(4)[i % 2]).tolist(), i % 2) for d in (1, 2) for i in range(8)]
    n = spark.createDataFrame(rows, "district_id long, building_id long, features array<double>, y int")
    e = spark.createDataFrame([(d, i, (i + 2) % 8, 1.0) for d in (1, 2) for i in range(8)], "district_id long, src long, dst long, distance double")
    config = training.TrainConfig(hidden=4, heads=1, layers=2, classes=2, epochs=3, rate=0.05, dropout=0.0, weight_decay=0.0, min_delta=0.0, lambda_smooth=0.0)
    state = training.train(n, e, config)
    assert state["history"][-1]["train_loss"] < state["history"][0]["train_loss"]
    training.save_checkpoint(spark, state, features.feature_stats(n), config, str(tmp_path / "c"))
    back, again, _ = training.load_checkpoint(spark, str(tmp_path / "c"))
    assert again == config
    more = training.train(n, e, training.TrainConfig(**vars(config) | {"epochs": 4}), start=back)
    assert [h["epoch"] for h in more["history"]] == [1, 2, 3, 4]


def test_clusters_and_votes(spark):
    m = np.kron(np.eye(2), np.ones((4, 4)))
    m[3, 4] = m[4, 3] = 0.05
    rows = [(1, i, j, float(m[i, j])) for i in range(8) for j in range(i, 8)]
    got = similarity.spectral_clusters(spark.createDataFrame(rows, "district_id long, i long, j long, affinity double"), 2).orderBy("building_id").collect()
    assert [r.spectral_cluster for r in got] == [0] * 4 + [1] * 4
    assert similarity.estimate_clusters(m) == 2 and similarity.estimate_clusters(np.ones((2, 2))) == 2 and similarity.estimate_clusters(np.ones((1, 1))) == 1
    tie = spark.createDataFrame([(1, 0, 5), (1, 0, 2), (1, 1, 3)], "district_id long, spectral_cluster long, gat_label long")
    assert {(r.spectral_cluster, r.gat_label) for r in similarity.majority_vote(tie).collect()} == {(0, 2), (1, 3)}


def test_metrics_and_results(spark):
    empty = spark.createDataFrame([], "y int, pred int")
    assert tuple(metrics.accuracy_f1(empty).first()) == (0, 0, 0)
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, pred int")
    assert abs(metrics.accuracy_f1(rows).first().f1_macro - (2 / 3 + 0.5 + 0) / 3) < 1e-12
    assert sum(r.n for r in metrics.confusion_matrix(rows).collect()) == 4
    old = spark.createDataFrame([(1, "a"), (2, "b")], "district_id long, v string")
    new = spark.createDataFrame([(2, "c")], "district_id long, v string")
    assert {tuple(r) for r in results.upserted(results.upserted(old, new), new).collect()} == {(1, "a"), (2, "c")}


def test_upsert_files_and_stream(spark, tmp_path):
    from terrafold.streaming.incremental import process_new

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "district_id long, v string")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        process_new(spark, str(tmp_path / "in"), "district_id long, v string", lambda d: d, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    results.write_upsert(spark.createDataFrame([(2, "c")], "district_id long, v string"), str(tmp_path / "out"))
    assert {(r.district_id, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "a"), (2, "c")}


def test_shapefile_and_pipeline(spark, tmp_path):
    import struct

    from terrafold.plans.pipeline import extract
    from terrafold.sources import shapefile, tables

    def write(path, boxes):
        body = b""
        for i, (x0, y0, x1, y1) in enumerate(boxes):
            pts = [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
            rec = struct.pack("<i4d2ii", 5, x0, y0, x1, y1, 1, 5, 0) + b"".join(struct.pack("<2d", *p) for p in pts)
            body += struct.pack(">2i", i + 1, len(rec) // 2) + rec
        path.with_suffix(".shp").write_bytes(b"\0" * 100 + body)
        field = b"FID".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([6, 0]) + b"\0" * 14
        dbf = struct.pack("<4BIHH20x", 3, 0, 0, 0, len(boxes), 65, 7) + field + b"\r" + b"".join(b" " + str(i + 1).rjust(6).encode() for i in range(len(boxes)))
        path.with_suffix(".dbf").write_bytes(dbf)
        return str(path.with_suffix(".shp"))

    shapefile.register(spark)
    load = lambda p, k: tables.load_shapes(spark.read.format("shapefile").load(p), k)
    d = load(write(tmp_path / "d", [(0, 0, 20, 10)]), "district_id")
    b = load(write(tmp_path / "b", [(1, 1, 4, 4), (10, 1, 14, 5)]), "building_id")
    out = extract(d, b, buffer=2.0)
    assert {(r.src, r.dst, r.distance) for r in out["edges"].collect()} == {(1, 2, 6.0), (2, 1, 6.0)}
    assert out["regions"].count() == 2
