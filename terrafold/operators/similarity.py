"""Pairwise affinity, spectral clustering and voting within districts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators import blocks, spectral
from terrafold.operators.blocks import BLOCK, Rule, whole
from terrafold.operators.spectral import block_labels
from terrafold.plans.lineage import cut


def unit_vectors(nodes: DataFrame) -> DataFrame:
    """``u``: features at unit length, zeros for a zero vector."""
    v = F.col("features").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return nodes.withColumn("_n", norm).withColumn("u", F.transform(v, lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0))).drop("_n")


#: Rows of a matrix product that are held at a time.
STRIPE = 256
PAIR = "district_id long, i long, j long, cosine double"


def _vectors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    u = rows["u"].combine_chunks()
    return rows["building_id"].to_numpy(), u.flatten().to_numpy().reshape(len(u), -1)


def _pair_kernel(keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]):
    """Pairs of two blocks, once each, that ``keep`` (lower ids, higher ids, cosines) leaves, stripe by stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        d, p, q = (group[c][0].as_py() for c in ("district_id", "p", "q"))
        of = group["b"].to_numpy()
        first, second = group.filter(pa.array(of == p)), group.filter(pa.array(of == q))
        if not len(first) or not len(second):
            return
        (ia, a), (ib, b) = _vectors(first), _vectors(second)
        for at in range(0, len(ia), STRIPE):
            i, c = ia[at : at + STRIPE, None], a[at : at + STRIPE] @ b.T
            lo, hi = np.minimum(i, ib), np.maximum(i, ib)
            taken = keep(lo, hi, c)
            if p == q:
                taken = taken & (i <= ib)
            yield pa.RecordBatch.from_pydict({"district_id": np.full(taken.sum(), d), "i": lo[taken], "j": hi[taken], "cosine": c[taken]})

    return run


def _block_pairs(nodes: DataFrame, block: int, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    units = unit_vectors(nodes).select("district_id", "building_id", "u")
    # a row a district
    sizes = nodes.groupBy("district_id").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    placed = units.join(F.broadcast(sizes), "district_id").withColumn("b", F.pmod(F.xxhash64("building_id"), F.col("nb")).cast("int"))
    ends = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = ends.select("district_id", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "building_id", "u")
    return rows.groupBy("district_id", "p", "q").applyInArrow(_pair_kernel(keep), PAIR)


def pairwise_cosine(nodes: DataFrame, block: int = 1024) -> DataFrame:
    """(district_id, i, j, cosine) for i <= j of one district: nodes are dealt to
    blocks, and each pair of blocks is one matrix product."""
    return _block_pairs(nodes, block, lambda lo, hi, c: np.ones(c.shape, bool))


def linked_pairs(nodes: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """The rows of ``pairwise_cosine`` with i < j and a cosine of ``least`` or more: the
    others never leave their block, of which a larger one sends a node to fewer places."""
    return _block_pairs(nodes, block, lambda lo, hi, c: (c >= least) & (lo < hi))


def affinity(
    node_pairs: DataFrame, edges: DataFrame, labels: DataFrame | None = None, scale: float = 1.0, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)
) -> DataFrame:
    """(district_id, i, j, affinity) for i <= j: cosine mapped to 0..1, equal class
    and closeness, weighted; min-max scaled over the district's matrix; 1 on the
    diagonal.  Without edges the closeness is 0 throughout."""
    near = edges.select("district_id", F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), "distance").groupBy("district_id", "i", "j").agg(F.min("distance").alias("distance"))
    closeness = F.when(F.coalesce("distance", F.lit(0.0)) == 0, 0.0).otherwise(F.exp(-F.col("distance") / F.lit(scale)))
    pairs = node_pairs.join(near, ["district_id", "i", "j"], "left")
    if labels is not None:
        side = lambda c: labels.select("district_id", F.col("building_id").alias(c), F.col("gat_label").alias(f"{c}_label"))
        pairs = pairs.join(side("i"), ["district_id", "i"]).join(side("j"), ["district_id", "j"])
        same = (F.col("i_label") == F.col("j_label")).cast("double")
    else:
        same = F.lit(0.0)
    diagonal = F.col("i") == F.col("j")
    raw = weights[0] * (F.col("cosine") + 1) / 2 + weights[1] * same + weights[2] * closeness
    raw = F.when(diagonal, 0.0).otherwise(raw)
    pairs = pairs.withColumn("raw", raw)
    # two numbers a district, summed up before the shuffle: no district's pairs meet in one task
    ends = pairs.groupBy("district_id").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    pairs = pairs.join(ends, "district_id")
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("raw"))
    return pairs.withColumn("scaled", scaled).select("district_id", "i", "j", F.when(diagonal, 1.0).otherwise(F.col("scaled")).alias("affinity"))


def _dealt(nodes: DataFrame, rule: Rule, block: int) -> tuple[DataFrame, DataFrame]:
    columns = ["u", *(["gat_label"] if "gat_label" in nodes.columns else [])]
    dealt = cut(blocks.node_blocks(unit_vectors(nodes).select("district_id", "building_id", *columns), columns, block))
    return dealt, cut(blocks.ends(dealt, rule))


def node_affinity(nodes: DataFrame, rule: Rule = Rule(), block: int = BLOCK) -> DataFrame:
    """``affinity`` of nodes with features, and ``gat_label`` where classes count, whose
    edges are the links of ``rule``: two passes over pairs of blocks, of which only the
    rows of the result and two numbers a district leave."""
    dealt, scaling = _dealt(nodes, rule, block)
    return blocks.affinity_rows(dealt, scaling, rule)


def node_clusters(nodes: DataFrame, rule: Rule = Rule(), clusters: int | None = None, block: int = BLOCK) -> DataFrame:
    """``spectral.block_clusters`` over ``node_affinity``, whose rows are never made: a
    product takes each tile from its two blocks anew."""
    dealt, scaling = _dealt(nodes, rule, block)
    ones = dealt.select("district_id", "b", F.transform("ids", lambda _: F.lit(1.0)).alias("v"))
    shares = blocks.products(dealt, scaling, rule, ones, 1).select("district_id", "b", F.explode(F.arrays_zip(F.col("ids").alias("ids"), F.col("y").alias("y"))).alias("e"))
    own = cut(shares.groupBy("district_id", "b", F.col("e.ids").alias("node")).agg(F.sum("e.y").alias("degree")))
    return spectral.clusters_by(lambda vectors, width: blocks.products(dealt, scaling, rule, vectors, width), own, clusters)


def estimate_clusters(matrix: np.ndarray, most: int = 15, least: int = 2) -> int:
    """Clusters by the largest gap of the Laplacian's smallest eigenvalues."""
    n = len(matrix)
    if n <= 2:
        return n
    values = np.linalg.eigvalsh(np.diag(matrix.sum(1)) - matrix)[: min(most, n - 1) + 1]
    return int(np.clip(np.argmax(np.diff(values)) + 1, least, min(most, n - 1)))


def kmeans(x: np.ndarray, k: int, starts: int = 10, seed: int = 42) -> np.ndarray:
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(x), int))
    for _ in range(starts):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres) ** 2).sum(2).min(1)
            p = d / d.sum() if d.sum() > 0 else None
            centres = np.vstack([centres, x[rng.choice(len(x), p=p)]])
        for _ in range(100):
            own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
            new = np.stack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        best = min(best, (((x - centres[own]) ** 2).sum(), own), key=lambda t: t[0])
    return best[1]


def spectral_labels(matrix: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Clusters numbered by their smallest node."""
    if k >= len(matrix):
        return np.arange(len(matrix))
    d = 1 / np.sqrt(np.maximum(matrix.sum(1), 1e-12))
    _, vectors = np.linalg.eigh(np.eye(len(matrix)) - d[:, None] * matrix * d)
    own = kmeans(vectors[:, :k] * d[:, None], k, seed=seed)
    first = {c: i for i, c in reversed(list(enumerate(own)))}
    number = {c: i for i, c in enumerate(sorted(first, key=first.get))}
    return np.array([number[c] for c in own])


#: Districts of up to this many nodes are solved in one task each, as a dense matrix (32 MB).
DENSE_NODES = 2_000


CLUSTER = "district_id long, building_id long, spectral_cluster long, error string"


def _dense_clusters(clusters: int | None):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([group["i"], group["j"]]))
        out = pd.DataFrame({"district_id": int(group["district_id"].iloc[0]), "building_id": ids, "spectral_cluster": None, "error": None})
        try:
            m = np.zeros((len(ids), len(ids)))
            a, b = np.searchsorted(ids, group["i"]), np.searchsorted(ids, group["j"])
            m[a, b] = m[b, a] = group["affinity"]
            out["spectral_cluster"] = spectral_labels(m, clusters or estimate_clusters(m))
        except np.linalg.LinAlgError as e:
            out["error"] = str(e)
        return out

    return run


def spectral_clusters(affinities: DataFrame, clusters: int | None = None, dense_nodes: int = DENSE_NODES) -> DataFrame:
    """(district_id, building_id, spectral_cluster, error).  Larger districts are
    solved by tiles and blocks over the cluster, with the same definition."""

    run = _dense_clusters(clusters)
    affinities = cut(affinities)
    sizes = cut(affinities.groupBy("district_id").agg(F.count_if(F.col("i") == F.col("j")).alias("n"), F.count("*").alias("pairs")))
    # as many pairs may stand without their diagonal
    large = sizes.where((F.col("n") > dense_nodes) | (F.col("pairs") > dense_nodes * (dense_nodes + 1) // 2)).select("district_id")
    if not large.limit(1).count():
        return affinities.groupBy("district_id").applyInPandas(run, CLUSTER)
    done = affinities.join(large, "district_id", "left_anti").groupBy("district_id").applyInPandas(run, CLUSTER)
    tiled = spectral.block_clusters(affinities.join(large, "district_id", "left_semi"), clusters)
    return done.unionByName(tiled.withColumn("error", F.lit(None).cast("string")))


def _block_clusters(rule: Rule, clusters: int | None, dense_nodes: int):
    """Clusters of blocks that are whole districts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                ids, m = whole(row, rule)
                out = pd.DataFrame({"district_id": row.district_id, "building_id": ids, "spectral_cluster": None, "error": None})
                try:
                    out["spectral_cluster"] = spectral_labels(m, clusters or estimate_clusters(m)) if len(ids) <= dense_nodes else block_labels(m, ids, clusters)
                except np.linalg.LinAlgError as e:
                    out["error"] = str(e)
                yield out

    return run


def spectral_clusters_of(nodes: DataFrame, rule: Rule = Rule(), clusters: int | None = None, dense_nodes: int = DENSE_NODES, block: int = BLOCK) -> DataFrame:
    """``spectral_clusters`` over ``node_affinity``, whose rows are never made.  A district of
    one block is solved where its block is, without rounds over the cluster."""
    sizes = nodes.groupBy("district_id").agg(F.count("*").alias("n"))
    large = cut(sizes.where(F.col("n") > max(block, dense_nodes)).select("district_id"))

    def alone(some: DataFrame) -> DataFrame:
        columns = ["u", *(["gat_label"] if "gat_label" in some.columns else [])]
        dealt = cut(blocks.node_blocks(unit_vectors(some).select("district_id", "building_id", *columns), columns, max(block, dense_nodes)))
        # a task a district
        n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return dealt.repartition(n, "district_id").mapInPandas(_block_clusters(rule, clusters, dense_nodes), CLUSTER)

    if not large.limit(1).count():
        return alone(nodes)
    tiled = node_clusters(nodes.join(large, "district_id", "left_semi"), rule, clusters, block)
    return alone(nodes.join(large, "district_id", "left_anti")).unionByName(tiled.withColumn("error", F.lit(None).cast("string")))


def majority_vote(assigned: DataFrame, cluster: str = "spectral_cluster", label: str = "gat_label") -> DataFrame:
    """(district_id, cluster, label): most frequent label of a cluster, ties to the smallest."""
    n = assigned.where(F.col(cluster).isNotNull()).groupBy("district_id", cluster, label).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col(label)).alias("neg")))
    return n.groupBy("district_id", cluster).agg(best.alias("best")).select("district_id", cluster, (-F.col("best.neg")).alias(label), F.col("best.n").alias("votes"))


def voted_labels(assigned: DataFrame, cluster: str = "spectral_cluster", label: str = "gat_label") -> DataFrame:
    votes = majority_vote(assigned, cluster, label).select("district_id", cluster, F.col(label).alias("final_label"))
    return assigned.join(votes, ["district_id", cluster], "left")


def principal_plane(nodes: DataFrame, dimensions: int = 2) -> DataFrame:
    """(district_id, building_id, projection): features on the leading principal
    directions of all nodes.  Second moments are summed on the cluster; the driver
    gets one matrix of features x features."""
    size = nodes.select(F.size("features").alias("n")).first()
    if size is None:
        return nodes.select("district_id", "building_id", F.col("features").alias("projection"))

    def moments(batches):
        total, outer, n = np.zeros(size["n"]), np.zeros((size["n"], size["n"])), 0
        for batch in batches:
            x = np.stack(batch["features"].to_list()).astype(float) if len(batch) else np.zeros((0, size["n"]))
            total, outer, n = total + x.sum(0), outer + x.T @ x, n + len(x)
        yield pd.DataFrame({"place": np.arange(outer.size + len(total) + 1), "v": np.concatenate([outer.ravel(), total, [n]])})

    sums = nodes.select("features").mapInPandas(moments, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").toPandas()["v"].to_numpy()
    d, n = size["n"], sums[-1]
    mean = sums[d * d : -1] / n
    _, vectors = np.linalg.eigh(sums[: d * d].reshape(d, d) / n - np.outer(mean, mean))
    axes = vectors[:, ::-1][:, :dimensions]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)  # signs don't depend on the solver

    @F.pandas_udf("array<double>")
    def project(features: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(features.to_list()).astype(float) - mean) @ axes)) if len(features) else pd.Series([], dtype=object)

    return nodes.select("district_id", "building_id", project("features").alias("projection"))
