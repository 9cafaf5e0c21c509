"""Sampled batches of large districts against a plain walk, and training and evaluation with them."""

import os
from collections import defaultdict

import numpy as np
import pytest

from terrafold.operators import attention, batches, graph, training
from terrafold.plans import lineage


@pytest.fixture(scope="module")
def graphs(spark):
    """District 1: a ring of 60 with a hub, a node without edges and a loop; district 2: 9 nodes."""
    rng = np.random.default_rng(3)
    nodes = [(d, i, (rng.normal(size=4) + 3 * np.eye(4)[i % 2]).tolist(), i % 2) for d, n in ((1, 62), (2, 9)) for i in range(n)]
    links = [(1, i, (i + k) % 60, 1.0 + k) for i in range(60) for k in (1, 2, 4)] + [(1, i, 60, 2.0) for i in range(60)] + [(1, 5, 5, 1.0)]
    links += [(2, i, (i + 2) % 8, 1.0) for i in range(8)]
    n = spark.createDataFrame(nodes, "district_id long, building_id long, features array<double>, y int")
    return n, spark.createDataFrame(links, "district_id long, src long, dst long, distance double").repartition(5), links


def walked(links, seeds, fan_out, seed, number):
    """(nodes, edges) of one batch, hop by hop."""
    f, p, into = batches.factor(number), batches.PRIME, defaultdict(list)
    for d, s, t, _ in links:
        if d == 1 and s != t:
            into[t].append(((s % p * f + seed + t % p * batches.STRIDE) % p, s))
    frontier, taken = set(seeds), set()
    for limit in fan_out:
        hop = {(s, t) for t in frontier for _, s in sorted(into[t])[:limit]}
        taken |= hop
        frontier = {s for s, _ in hop}
    return set(seeds) | {i for e in taken for i in e}, taken


def plan_of(n, threshold=30, size=16):
    return lineage.cut(graph.sampling_plan(n, threshold, size).where("not is_full"))


def test_batches_against_a_walk(graphs):
    n, e, links = graphs
    dealt = []
    for number in (1, 2):
        plan = plan_of(n)
        assert [(r.district_id, r.n_batches) for r in plan.collect()] == [(1, 4)]
        members, edges = (t.collect() for t in batches.sampled(n, e, plan, (3, 2), 42, number))
        seeds = defaultdict(list)
        for r in members:
            if r.is_seed:
                seeds[r.batch].append(r.building_id)
        assert sorted(i for b in seeds.values() for i in b) == list(range(62))  # each node is a seed once
        for b, own in seeds.items():
            nodes, taken = walked(links, own, (3, 2), 42, number)
            assert nodes == {r.building_id for r in members if r.batch == b}
            assert taken == {(r.src, r.dst) for r in edges if r.batch == b}
            assert len([r for r in edges if r.batch == b]) == len(taken)
        dealt.append({frozenset(own) for own in seeds.values()})
    assert dealt[0] != dealt[1]  # other batches each epoch


def test_no_hops_no_edges_and_no_large_district(spark, graphs):
    n, e, _ = graphs
    members, edges = batches.sampled(n, e, plan_of(n), ())
    assert members.count() == 62 and members.where("not is_seed").count() == 0 and edges.count() == 0
    members, edges = batches.sampled(n, e.limit(0), plan_of(n), (3, 2))
    assert members.count() == 62 and edges.count() == 0
    members, edges = batches.sampled(n, e, plan_of(n, 1000), (3, 2))
    assert members.count() == 0 and edges.count() == 0


def test_hubs_are_limited_before_the_exchange(graphs):
    n, e, _ = graphs
    text = batches.ranked(e, 3)._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2  # once in each task, once after


def test_a_step_for_each_batch(graphs, spark, tmp_path):
    n, e, _ = graphs
    config = training.TrainConfig(hidden=4, heads=2, layers=2, classes=2, epochs=2, rate=0.05, dropout=0.0, node_threshold=30, batch_size=16, fan_out=(3, 2))
    state = training.train(n, e, config, val=(n, e))
    assert state["steps"] == 2 * (4 + 1)  # four batches, and the small district
    assert state["history"][-1]["val_loss"] < state["history"][0]["val_loss"]
    two = training.train(n, e, training.TrainConfig(**vars(config) | {"parallel_batches": 2, "accumulation": 3}))
    assert two["steps"] == 2  # one whole district and two pairs of batches make one gradient each


def test_evaluation_by_joins_equals_that_in_a_task(graphs):
    n, e, _ = graphs
    net = attention.Network.random(4, 3, 2, layers=2, heads=2)
    e = e.where("src <> dst")
    by_joins = training.evaluate(n, e, net, training.TrainConfig(node_threshold=30))
    assert np.allclose(by_joins, training.evaluate(n, e, net, training.TrainConfig(node_threshold=1000)))


def test_tables_of_an_epoch_go(spark):
    with lineage.passing(spark):
        inner = lineage.cut(spark.range(5))
        folder = inner.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert inner.count() == 5 and os.path.isdir(folder)
    kept = lineage.cut(spark.range(3))
    assert not os.path.isdir(folder) and kept.count() == 3


def test_a_batch_needs_no_exchange(graphs):
    """A step reads one row and gives what the batch's group of tables gives."""
    n, e, _ = graphs
    plan = plan_of(n)
    steps = lineage.cut(batches.numbered_batches(plan))
    packed = batches.stepped(n, e, plan, steps, (3, 2), 42, 1)
    config, net = training.TrainConfig(dropout=0.3), attention.Network.random(4, 3, 2, layers=2, heads=2)
    one = training.batch_epoch(packed.where("step = 2"), net, config, 1)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    members, links = batches.sampled(n, e, plan, (3, 2), 42, 1)
    own, links = (lineage.cut(t.join(steps, batches.BATCH)) for t in (members.join(n, ["district_id", "building_id"]), links))
    grouped = training.epoch(own, links, net, config, 1, by=("district_id", "step"))
    want = sorted((r.n, round(r.loss, 9), r.correct, np.round(r.gradient, 9).tolist()) for r in grouped.collect())
    assert sorted((r.n, round(r.loss, 9), r.correct, np.round(r.gradient, 9).tolist()) for r in training.batch_epoch(packed, net, config, 1).collect()) == want
