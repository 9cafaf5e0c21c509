"""Runs from files to predictions, and operators at sizes where they once failed."""

import json
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold import __main__ as command
from terrafold import logs
from terrafold.functions import geometry as G
from terrafold.functions import kernels as K
from terrafold.operators import attention, features, metrics, raster, results, similarity, spatial, training
from terrafold.sources import settings, tables


def shapefile(path, polygons, columns):
    """Writes .shp and .dbf of polygons (rings of points) with number columns."""
    body = b""
    for i, ring in enumerate(polygons):
        pts = [tuple(map(float, p)) for p in ring]
        rec = struct.pack("<i4d2ii", 5, 0, 0, 0, 0, 1, len(pts), 0) + b"".join(struct.pack("<2d", *p) for p in pts)
        body += struct.pack(">2i", i + 1, len(rec) // 2) + rec
    path.with_suffix(".shp").write_bytes(b"\0" * 100 + body)
    fields = b"".join(c.encode().ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([6, 0]) + b"\0" * 14 for c in columns)
    n = len(polygons)
    rows = b"".join(b" " + b"".join(str(columns[c][i]).rjust(6).encode() for c in columns) for i in range(n))
    path.with_suffix(".dbf").write_bytes(struct.pack("<4BIHH20x", 3, 0, 0, 0, n, 33 + 32 * len(columns), 1 + 6 * len(columns)) + fields + b"\r" + rows)
    return str(path.with_suffix(".shp"))


def box(x0, y0, x1, y1):
    return [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]


def test_extract_train_infer(spark, tmp_path):
    u = [(0, 0), (0, 20), (8, 20), (8, 8), (14, 8), (14, 20), (22, 20), (22, 0), (0, 0)]
    districts = shapefile(tmp_path / "d", [u, box(40, 0, 60, 20), [(90, 0), (91, 0)]], {"FID": [1, 2, 3]})
    (tmp_path / "d.prj").write_text('PROJCS["WGS_1984_UTM_Zone_50N",GEOGCS["GCS_WGS_1984"]]')
    b = [box(1, 1, 4, 4), box(1, 12, 4, 15), box(16, 12, 20, 18), box(9, 10, 13, 14), box(41, 1, 45, 5), box(50, 8, 54, 12), box(55, 2, 58, 6), [(43, 12), (46, 15), (46, 12), (43, 15), (43, 12)]]
    buildings = shapefile(tmp_path / "b", b, {"FID": range(1, 9), "label": [1, 2, 1, 2, 1, 2, 1, 2]})
    assert tables.crs_of(spark, districts) == "EPSG:32650" and tables.crs_of(spark, buildings) is None
    out = str(tmp_path / "out")
    command.main(["extract", districts, buildings, out, "--buffer", "2", "--logs", str(tmp_path / "logs")])
    kept = spark.read.parquet(f"{out}/buildings").select("district_id", "building_id", G.area(F.col("geometry")).alias("a")).collect()
    # building 4 stands in the gap of district 1; building 8 was repaired to two triangles
    assert {(r.district_id, r.building_id): r.a for r in kept} == {(1, 1): 9, (1, 2): 9, (1, 3): 24, (2, 5): 16, (2, 6): 16, (2, 7): 12, (2, 8): 4.5}
    failed = spark.read.parquet(f"{out}/failed").collect()
    assert [(r.district_id, r.error) for r in failed] == [(3, "a ring has less than four points")] and spark.read.parquet(f"{out}/missing").first().district_id == 3
    polygons = spark.read.parquet(f"{out}/polygons").groupBy("district_id").agg(F.sum("area").alias("a")).collect()
    areas = spark.read.parquet(f"{out}/regions").groupBy("district_id").agg(F.sum("area").alias("a")).collect()
    assert {tuple(r) for r in polygons} == {tuple(r) for r in areas}
    about = spark.read.parquet(f"{out}/raster/about").where("district_id = 2").first()
    assert about.transform == [1, 0, 38, 0, -1, 22] and about.crs == "EPSG:32650"
    (tmp_path / "c.yaml").write_text("model:\n  hidden_dim: 4\n  num_heads: 2\n  num_layers: 2\ndata:\n  num_classes: 2\ntraining:\n  lr: 0.05\n  epochs: 4\n  min_delta: 0.0001\nother:\n  nonsense: 1\n")
    command.main(["train", out, str(tmp_path / "run"), "--config", str(tmp_path / "c.yaml"), "--logs", str(tmp_path / "logs")])
    assert [json.loads(r.value)["epoch"] for r in spark.read.text(str(tmp_path / "run/history")).collect()] == [1, 2, 3, 4]
    assert json.loads((tmp_path / "logs/config.json").read_text())["hidden"] == 4 and len(list((tmp_path / "logs").glob("terrafold_*.log"))) >= 1
    command.main(["infer", out, str(tmp_path / "run/checkpoints/last"), str(tmp_path / "said")])
    said = spark.read.parquet(str(tmp_path / "said/predictions")).collect()
    assert len(said) == 7 and all(len(r.embedding) == 8 and len(r.logits) == 2 and r.gat_label in (0, 1) and r.original_label in (1, 2) for r in said)
    command.main(["train", out, str(tmp_path / "more"), "--config", str(tmp_path / "c.yaml"), "--resume", str(tmp_path / "run/checkpoints/last"), "--epochs", "6"])
    assert spark.read.parquet(str(tmp_path / "more/metrics")).agg(F.max("epoch")).first()[0] == 6
    logs.set_up()


def test_numbers_lose_no_row(spark):
    wide = spark.range(300_000).select(F.col("id"), F.repeat(F.lit("x"), 400).alias("pad"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"))
    got = spatial.numbered(wide.withColumn("key", F.struct("k", "id")), "key", "n", 1).select("n", "k", "id")
    s = got.agg(F.count("*").alias("c"), F.count_distinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    assert tuple(s) == (300_000, 300_000, 1, 300_000)
    first = [(r.k, r.id) for r in got.orderBy("n").limit(2000).collect()]
    assert first == sorted(first)
    two = [wide.limit(50_000).withColumnRenamed("id", "segment_id")] * 2
    assert spatial.merge_segments(two).count() == 100_000


def test_network_of_default_size(spark):
    rng = np.random.default_rng(0)
    net = attention.Network.random(13, 64, 9)
    x, links = rng.normal(size=(300, 13)), np.unique(rng.integers(0, 300, (1500, 2)), axis=0)
    n = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "district_id long, building_id long, features array<double>")
    e = spark.createDataFrame([(1, int(a), int(b)) for a, b in links], "district_id long, src long, dst long")
    began = time.time()
    got = np.array([r.logits for r in attention.forward(n, e, net).orderBy("building_id").collect()])
    assert time.time() - began < 60 and np.allclose(got, attention.forward_numpy(net, x, links)[-1]["z"], atol=1e-9)
    weights = net.attention(n, e, 1).groupBy("dst").agg(F.sum("alpha").alias("a")).collect()
    assert len(weights) == 300 and all(abs(r.a - 1) < 1e-9 for r in weights) and "276507 parameters" in repr(net)
    with pytest.raises(ValueError):
        net.attention(n, e, 3)
    before = net.layers[0].weight.copy()
    net.reset(7)
    assert net.layers[0].weight.shape == before.shape and not np.allclose(net.layers[0].weight, before)


def test_training_in_batches(spark):
    rng = np.random.default_rng(1)
    rows = [(d, i, (rng.normal(size=4) + 3 * np.eye(4)[i % 2]).tolist(), i % 2) for d in range(4) for i in range(40)]
    n = spark.createDataFrame(rows, "district_id long, building_id long, features array<double>, y int")
    e = spark.createDataFrame([(d, i, (i + k) % 40, 1.0) for d in range(4) for i in range(40) for k in (2, 4, 6)], "district_id long, src long, dst long, distance double")
    saved = []
    config = training.TrainConfig(hidden=4, heads=2, layers=2, classes=2, epochs=4, rate=0.05, dropout=0.2, weight_decay=5e-4, node_threshold=30, batch_size=16, fan_out=(2, 2), graph_batches=2, checkpoint_interval=2)
    state = training.train(n, e, config, val=(n, e), saved=lambda s, best: saved.append((s["epoch"], best)))
    assert state["history"][-1]["val_loss"] < state["history"][0]["val_loss"] and state["steps"] == 4 * 4 * 3 and any(best for _, best in saved)
    again = training.train(n.repartition(3), e.repartition(5), config, val=(n, e))
    assert np.allclose(state["params"], again["params"])  # batches and masks don't depend on the order of rows
    net = attention.Network.random(3, 2, 3, layers=2, heads=2)
    x, links, y = rng.normal(size=(5, 3)), np.array([(0, 1), (1, 2), (3, 4)]), rng.integers(0, 3, 5)
    masks, seeds, at = training.dropped(net, 5, 0.4, rng), np.array([1, 3]), training.flat(net)
    one = lambda p: training.loss_and_gradient(training.unflat(net, p), x, links, np.ones(3), y, 0.5, 1.0, seeds, masks)
    grad = one(at)[2]
    for i in rng.choice(len(at), 20, replace=False):
        step = np.zeros_like(at)
        step[i] = 1e-6
        assert abs((one(at + step)[0] - one(at - step)[0]) / 2e-6 - grad[i]) < 1e-5


def test_components_and_fillings_like_plain_floods():
    def flood(labels):
        out, k = np.zeros(labels.shape, int), 0
        for start in zip(*np.nonzero(labels > 0), strict=True):
            if out[start]:
                continue
            k += 1
            todo = [start]
            out[start] = k
            while todo:
                r, c = todo.pop()
                for s in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                    if 0 <= s[0] < labels.shape[0] and 0 <= s[1] < labels.shape[1] and not out[s] and labels[s] == labels[start]:
                        out[s] = k
                        todo.append(s)
        return out

    rng = np.random.default_rng(2)
    for shape in ((1, 1), (1, 9), (9, 1), (12, 17), (40, 30)):
        labels = rng.integers(-1, 3, shape)
        got = K.components4(labels)
        assert np.array_equal(got, flood(labels))
        for k, place in K.components_at(got):
            assert (got[place] == k).sum() == (got == k).sum() and place == K.crop(got == k)
    big = np.repeat(np.repeat(rng.integers(1, 200, (60, 60)), 25, 0), 25, 1)
    began = time.time()
    assert K.components4(big).max() > 1000 and time.time() - began < 20
    merged = K.merge_lines([np.array([(i, 0), (i + 1, 0)]) for i in rng.permutation(3000)])
    assert len(merged) == 1 and len(merged[0]) == 3001


def test_unions_firsts_and_projections(spark):
    rows = [(1, c, [[[(x, 0.0), (x + 1.0, 0.0), (x + 1.0, 1.0), (x, 1.0), (x, 0.0)]]], p) for p, (c, x) in enumerate([(0, float(i)) for i in range(10)] + [(1, 20.0), (1, 30.0)])]
    m = spark.createDataFrame(rows, f"district_id long, spectral_cluster long, geometry {G.GEOMETRY}, row_pos long")
    got = {r.spectral_cluster: r for r in spatial.cluster_geometry(m, fan_in=3).withColumn("area", G.area(F.col("geometry"))).collect()}
    assert got[0].area == 10 and got[0].n == 10 and len(got[0].geometry) == 1 and len(got[0].geometry[0][0]) == 5 and len(got[1].geometry) == 2
    assert spatial.first_geometry(m).first().geometry[0][0][0].x == 0
    cells = spark.createDataFrame([(1, 0, c, int(v)) for c, v in enumerate([1, 1, 2, 1])], raster.CELL)
    assert {(r.label, r.area, len(r.geometry)) for r in raster.segment_polygons(cells).collect()} == {(1, 3, 2), (2, 1, 1)}
    assert {r.label: (r.red, r.green, r.blue) for r in raster.label_colours(spark.createDataFrame([(0,), (5,), (5,)], "label long")).collect()}[0] == (200, 200, 200)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3)) * [5, 1, 0.1]
    n = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "district_id long, building_id long, features array<double>")
    p = np.array([r.projection for r in similarity.principal_plane(n).orderBy("building_id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(p), np.abs(u[:, :2] * s[:2]), atol=1e-8)


def test_reports_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, [2.0, 0.0], True), (1, 0, [1.0, 0.0], False), (1, 1, [0.0, 3.0], True)], "y int, pred int, logits array<double>, m boolean")
    whole, masked = metrics.metric_bundle(rows).first(), metrics.metric_bundle(rows, "m").first()
    assert whole.n == 3 and masked.n == 2 and masked.accuracy == 1 and abs(masked.loss - (np.log(1 + np.exp(-2)) + np.log(1 + np.exp(-3))) / 2) < 1e-9
    e = spark.createDataFrame([(3, 7, 1.5), (7, 3, 1.5), (7, 9, 2.0)], "src long, dst long, distance double")
    results.export_matrix(e, str(tmp_path / "m"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert sorted(lines) == sorted(["src,3,7,9", "3,0.0,1.5,0.0", "7,1.5,0.0,2.0", "9,0.0,0.0,0.0"])
    assert [r.district_id for r in results.missing(spark.range(3).withColumnRenamed("id", "district_id"), spark.range(2).withColumnRenamed("id", "district_id")).collect()] == [2]
    with pytest.raises(ValueError):
        tables.required(e, ["FID"])
    (tmp_path / "c.yaml").write_text("training:\n  num_neighbors: [5, 3]\n  weight_decay: 0.001\n")
    assert settings.train_config(str(tmp_path / "c.yaml")).fan_out == (5, 3)
    assert not settings.backup(settings.ExtractConfig(), "/proc/none/c.json")
    assert features.feature_stats(spark.createDataFrame([(1, 1, [1.0])], "district_id long, building_id long, features array<double>")).first().sd == 1
