"""Clustering by tiles gives the dense form's partition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import attention, batches, blocks, graph, similarity, spectral


def planted(seed, groups, between, noise=0.05):
    """A symmetric affinity with groups of the given sizes, in shuffled order of nodes."""
    rng = np.random.default_rng(seed)
    own = rng.permutation(np.repeat(np.arange(len(groups)), groups))
    m = np.where(own[:, None] == own, 0.9, between) + noise * rng.random((len(own), len(own)))
    m = np.triu(m, 1)
    return own, m + m.T + np.eye(len(own))


def rows_of(spark, districts):
    rows = [(d, int(i) * 3, int(j) * 3, float(m[i, j])) for d, m in districts.items() for i in range(len(m)) for j in range(i, len(m))]
    return spark.createDataFrame(rows, "district_id long, i long, j long, affinity double")


def numbered(own):
    first = {c: i for i, c in reversed(list(enumerate(own)))}
    order = sorted(first, key=first.get)
    return [order.index(c) for c in own]


def test_blocks_equal_dense(spark):
    cases = {1: planted(1, [20, 30, 25], 0.02), 2: planted(2, [28, 24], 0.0), 3: planted(3, [15, 15, 15, 20], 0.05)}
    pairs = rows_of(spark, {d: m for d, (_, m) in cases.items()})
    dense = similarity.spectral_clusters(pairs).collect()
    tiled = spectral.block_clusters(pairs, block=16).collect()
    as_set = lambda rows: {(r.district_id, r.building_id, r.spectral_cluster) for r in rows}
    assert as_set(dense) == as_set(tiled)
    for d, (own, _) in cases.items():
        got = [r.spectral_cluster for r in sorted(tiled, key=lambda r: r.building_id) if r.district_id == d]
        assert got == numbered(own)


def test_eigenvalues_equal_dense(spark):
    _, m = planted(5, [9, 14, 22], 0.3, noise=0.3)
    tiles, nodes = spectral.tiled(rows_of(spark, {7: m}), 10)
    lap = spectral.leading(tiles, nodes, spectral.LAPLACE, 8, wanted=5).first()
    want = np.linalg.eigvalsh(np.diag(m.sum(1)) - m)
    assert np.allclose(lap.top - np.array(lap.lam)[:5], want[:5], atol=1e-5)
    norm = spectral.leading(tiles, nodes, spectral.NORMAL, 6, wanted=4).first()
    d = 1 / np.sqrt(m.sum(1))
    assert np.allclose(np.array(norm.lam)[:4], np.linalg.eigvalsh(d[:, None] * m * d)[::-1][:4], atol=1e-6)


def test_no_district_is_dropped(spark):
    """Above the size of a dense matrix the same nodes get clusters and no error."""
    own, m = planted(6, [30, 30], 0.0)
    small = planted(8, [4, 5], 0.0)
    pairs = rows_of(spark, {1: m, 2: small[1]})
    got = similarity.spectral_clusters(pairs, dense_nodes=50).orderBy("district_id", "building_id").collect()
    assert len(got) == 69 and all(r.error is None for r in got)
    assert [r.spectral_cluster for r in got if r.district_id == 1] == numbered(own)
    assert [r.spectral_cluster for r in got if r.district_id == 2] == numbered(small[0])


@pytest.mark.parametrize("k", [1, 3])
def test_fewer_nodes_than_vectors(spark, k):
    _, m = planted(9, [3], 0.0)
    got = spectral.block_clusters(rows_of(spark, {1: m}), clusters=k, block=2).collect()
    assert sorted(r.building_id for r in got) == [0, 3, 6] and len({r.spectral_cluster for r in got}) == k


def test_empty(spark):
    none = spark.createDataFrame([], "district_id long, i long, j long, affinity double")
    assert similarity.spectral_clusters(none).collect() == []
    assert spectral.block_clusters(none, 2).where(F.lit(True)).collect() == []


def test_linked_pairs_in_blocks(spark):
    """Only linked pairs leave a block, and no window gathers a district."""
    rng = np.random.default_rng(5)
    rows = [(int(k % 2), int(k), rng.normal(size=4).tolist()) for k in range(60)] + [(0, 100, [0.0] * 4)]
    n = spark.createDataFrame(rows, "district_id long, building_id long, features array<double>")
    want = {(r.district_id, r.i, r.j, round(r.cosine, 9)) for r in similarity.pairwise_cosine(n, 7).collect() if r.i < r.j and r.cosine >= 0.2}
    got = [(r.district_id, r.i, r.j, round(r.cosine, 9)) for r in similarity.linked_pairs(n, 0.2, 7).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_edges_by_parts(spark):
    """Figures of districts, forests of tasks and limits before the exchange give what whole districts give."""
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(3)), int(a), int(b), float(rng.integers(1, 5))) for a, b in rng.integers(0, 40, (60, 2)) if a != b]
    e = spark.createDataFrame(rows * 2, "district_id long, src long, dst long, weight double").repartition(5)
    methods = ("sum", "max", "minmax", "standard")
    by = e.select("district_id", "src", "dst", "weight", *(graph.normalized_weights(e, m).alias(f"by_{m}") for m in methods))
    key = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.collect())
    assert key(graph.weights_by(e, methods)) == key(by)
    n = spark.createDataFrame([(d, k) for d in range(3) for k in range(40)], "district_id long, building_id long")
    whole = {(r.district_id, r.building_id): r.component for r in graph.connected_components(n, e).collect()}
    cutoff = {(r.district_id, r.building_id): r.component for r in graph.connected_components(n, graph.forests(e, 3)).collect()}
    root = {(d, k): k for d in range(3) for k in range(40)}
    for _ in range(40):
        for d, a, b, _w in rows:
            root[d, a] = root[d, b] = min(root[d, a], root[d, b])
    order = {d: sorted({v for (x, _), v in root.items() if x == d}) for d in range(3)}
    assert whole == cutoff == {k: order[k[0]].index(v) for k, v in root.items()}
    took: dict[tuple, list] = {}
    for d, a, b in sorted({r[:3] for r in rows}):
        took.setdefault((d, b), []).append(((a * 7919 + b * 104729 + 42) % 1000003, a))
    want = {(d, a, b) for (d, b), v in took.items() for _, a in sorted(v)[:2]}
    got = [tuple(r) for r in graph.sampled_edges(e, (2,)).select("district_id", "src", "dst").collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.fixture(scope="module")
def dealt(spark):
    rng = np.random.default_rng(8)
    rows = [(d, 3 * k, (rng.normal(size=4) * 0.4 + 3 * np.eye(4)[k % 3]).tolist(), int(k % 3)) for d, n in ((1, 43), (2, 5)) for k in range(n)]
    return spark.createDataFrame(rows, "district_id long, building_id long, features array<double>, gat_label long")


def test_affinity_of_nodes_equals_that_of_rows(spark, dealt):
    """Pairs of blocks give the rows that pairs joined with written edges give."""
    links = similarity.linked_pairs(dealt, 0.3, 7)
    e = links.select("district_id", F.col("i").alias("src"), F.col("j").alias("dst"), (1 - F.col("cosine")).alias("distance"))
    as_set = lambda df: sorted((r.district_id, r.i, r.j, round(r.affinity, 9)) for r in df.collect())
    want = as_set(similarity.affinity(similarity.pairwise_cosine(dealt), e, dealt.select("district_id", "building_id", "gat_label")))
    assert as_set(similarity.node_affinity(dealt, blocks.Rule(0.3), block=9)) == want
    bare = as_set(similarity.affinity(similarity.pairwise_cosine(dealt), e.limit(0)))
    assert as_set(similarity.node_affinity(dealt.drop("gat_label"), block=9)) == bare


def test_clusters_without_rows_of_pairs(spark, dealt, monkeypatch):
    """Large districts are solved though no row a pair is made."""
    as_set = lambda df: {tuple(r) for r in df.select("district_id", "building_id", "spectral_cluster").collect()}
    want = as_set(similarity.spectral_clusters(similarity.node_affinity(dealt, blocks.Rule(0.3), 9)))
    monkeypatch.setattr(blocks, "affinity_rows", None)
    assert as_set(similarity.node_clusters(dealt, blocks.Rule(0.3), block=9)) == want


def test_attention_without_edges(spark, dealt):
    """Shares of pairs of blocks give the softmax over written edges; heads are concatenated or averaged."""
    links = similarity.linked_pairs(dealt, 0.3)
    way = lambda a, b: links.select("district_id", F.col(a).alias("src"), F.col(b).alias("dst"))
    e = way("i", "j").unionByName(way("j", "i"))
    as_map = lambda df: {(r.district_id, r.building_id): r.features for r in df.collect()}
    for layer in attention.Network.random(4, 3, 2, 1, 2).layers + attention.Network.random(4, 3, 2, 2, 2).layers[:1]:
        want, got = as_map(attention.attention_layer(dealt, e, layer)), as_map(attention.linked_layer(dealt, layer, 0.3, block=9))
        assert want.keys() == got.keys() and all(np.allclose(want[k], got[k]) for k in want)


def test_tasks_leave_few_edges(spark):
    """What goes on to be put in order is bounded by the nodes, not the edges."""
    e = spark.range(400, numPartitions=1).select(F.lit(1).cast("long").alias("district_id"), F.col("id").alias("src"), (F.col("id") % 2).alias("dst"), F.lit(1.0).alias("distance"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    kept = batches.foremost(e, 3, gathered=60).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    f = batches.factor(0)
    key = lambda s, d: ((s * f + 42 + d * batches.STRIDE) % batches.PRIME, s)
    want = {(s, d) for d in (0, 1) for s in sorted((s for s in range(400) if s % 2 == d and s != d), key=lambda s: key(s, d))[:3]}
    assert {(r.src, r.dst) for r in kept} == want and len(kept) == 6


@pytest.mark.parametrize("dense_nodes, block", [(8, 4096), (8, 16), (4096, 4096)])
def test_one_block_needs_no_rounds(spark, monkeypatch, dense_nodes, block):
    """The same groups from a dense matrix, from a block alone, and from pairs of blocks."""
    rng = np.random.default_rng(3)
    centres = np.eye(3, 6)
    rows = [(d, i, (centres[i % (2 + d)] + 0.05 * rng.random(6)).tolist(), i % (2 + d)) for d in (0, 1) for i in range(40)]
    nodes = spark.createDataFrame(rows, "district_id long, building_id long, features array<double>, gat_label int")
    calls = []
    plain = similarity.node_clusters
    monkeypatch.setattr(similarity, "node_clusters", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = similarity.spectral_clusters_of(nodes, blocks.Rule(0.15), dense_nodes=dense_nodes, block=block).collect()
    assert bool(calls) == (block == 16)
    want = similarity.spectral_clusters(similarity.node_affinity(nodes, blocks.Rule(0.15))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    # two groups of equal ones, the gap of which is found
    assert {(r.building_id, r.spectral_cluster) for r in got if r.district_id == 0} == {(i, i % 2) for i in range(40)}
