"""Spectral clustering of districts of any size.

The affinity matrix lies in tiles, vectors in blocks of rows.  Leading
eigenvectors come from a block iteration that searches the space of the present
vectors, their residuals and the last step: a round is one product (tiles joined
with blocks, partial products summed), and one small problem a district whose
size doesn't depend on the district.  k-means seeds by farthest points and sums
on the cluster.  Nothing of a district's size meets in one task or the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.plans.lineage import cut

#: Nodes in a block: a tile has the square of it at most.
BLOCK = 256
#: Rounds of an eigenproblem, and the change of its values at which it ends.
ROUNDS, SETTLED = 60, 1e-7
NORMAL, LAPLACE = "normal", "laplace"
VECTORS = "district_id long, b long, ids array<long>, d array<double>, top double, x array<double>, mx array<double>, p array<double>, mp array<double>, lam array<double>"


def tiled(affinities: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Tiles (district_id, bi, bj, e) of (i, j, a) in both directions, and nodes
    (district_id, node, b, degree) dealt to blocks by a hash."""
    pairs = affinities.select("district_id", "i", "j", F.col("affinity").alias("a"))
    both = pairs.unionByName(pairs.where("i <> j").select("district_id", F.col("j").alias("i"), F.col("i").alias("j"), "a"))
    nodes = cut(both.groupBy("district_id", F.col("i").alias("node")).agg(F.sum("a").alias("degree")))
    sizes = nodes.groupBy("district_id").agg(F.ceil(F.count("*") / block).alias("nb"))
    at = lambda c: F.pmod(F.xxhash64(c), F.col("nb"))
    dealt = both.join(sizes, "district_id").withColumn("bi", at("i")).withColumn("bj", at("j"))
    tiles = dealt.groupBy("district_id", "bi", "bj").agg(F.collect_list(F.struct("i", "j", "a")).alias("e"))
    packed = tiles.select("district_id", "bi", "bj", F.col("e.i").alias("i"), F.col("e.j").alias("j"), F.col("e.a").alias("a"))
    return cut(packed), cut(nodes.join(sizes, "district_id").withColumn("b", at("node")).drop("nb"))


def _start(width: int):
    """Vectors by a rule of the node's id: the constant one and pseudo-random ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = []
            for ids in rows["ids"]:
                with np.errstate(over="ignore"):
                    h = (np.asarray(ids).astype(np.uint64)[:, None] + np.uint64(1)) * (np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(32)
                v = h.astype(np.float64) / 2.0**64 - 0.5
                v[:, 0] = 1.0
                x.append(v.ravel())
            empty = [np.zeros(0)] * len(rows)
            if len(rows):
                yield rows.assign(x=x, mx=empty, p=empty, mp=empty, lam=empty)

    return run


def _searched(row, width: int) -> np.ndarray:
    """The vectors that the next product is asked of: the start, then residuals."""
    x = np.asarray(row.x).reshape(-1, width)
    return x if len(row.mx) == 0 else np.asarray(row.mx).reshape(-1, width) - x * np.asarray(row.lam)


def _root(degrees) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(np.asarray(degrees), 1e-12))[:, None]


def _partial(kind: str, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.itertuples():
                v = _searched(row, width)
                v = v * _root(row.d) if kind == NORMAL else v
                ids = np.asarray(row.ids)
                own, place = np.unique(np.asarray(row.i), return_inverse=True)
                tile = np.zeros((len(own), len(ids)))
                tile[place, np.searchsorted(ids, np.asarray(row.j))] = np.asarray(row.a)
                out.append((row.district_id, row.bi, own, (tile @ v).ravel()))
            if out:
                yield pd.DataFrame(out, columns=["district_id", "b", "ids", "y"])

    return run


def _sent(kind: str, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            v = [(_searched(r, width) * (_root(r.d) if kind == NORMAL else 1)).ravel() for r in rows.itertuples()]
            yield rows[["district_id", "b"]].assign(v=v)

    return run


#: Tiles as rows, or what gives the shares (district_id, b, ids, y) of a product with vectors (district_id, b, v) of a width.
Tiles = DataFrame | Callable[[DataFrame, int], DataFrame]


def _multiplied(tiles: Tiles, vectors: DataFrame, kind: str, width: int) -> DataFrame:
    """``vectors`` with the searched ones ``w`` and their products ``mw``."""
    if callable(tiles):
        sent = vectors.select("district_id", "b", "d", "x", "mx", "lam").mapInPandas(_sent(kind, width), "district_id long, b long, v array<double>")
        parts = tiles(sent, width)
    else:
        sent = vectors.select("district_id", F.col("b").alias("bj"), "ids", "d", "x", "mx", "lam")
        parts = tiles.join(sent, ["district_id", "bj"]).mapInPandas(_partial(kind, width), "district_id long, b long, ids array<long>, y array<double>")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = next(left.itertuples())
        ids, w = np.asarray(row.ids), _searched(row, width)
        total = np.zeros_like(w)
        for own, y in zip(right["ids"], right["y"], strict=True):
            total[np.searchsorted(ids, own)] += np.asarray(y).reshape(-1, width)
        mw = total * _root(row.d) if kind == NORMAL else (row.top - np.asarray(row.d))[:, None] * w + total
        return left.assign(w=[w.ravel()], mw=[mw.ravel()])

    return vectors.groupBy("district_id", "b").cogroup(parts.groupBy("district_id", "b")).applyInPandas(run, VECTORS + ", w array<double>, mw array<double>")


def _sides(row, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The searched space and its product, block by block of columns."""
    of = lambda *names: np.hstack([np.asarray(v).reshape(-1, width) for n in names if len(v := getattr(row, n))])
    return (of("w"), of("mw")) if len(row.mx) == 0 else (of("x", "w", "p"), of("mx", "mw", "mp"))


def _moments(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for rows in batches:
            for row in rows.itertuples():
                k, mk = _sides(row, width)
                both = np.concatenate([(k.T @ k).ravel(), (k.T @ mk).ravel()])
                sums[row.district_id] = sums.get(row.district_id, 0) + both
        if sums:
            yield pd.DataFrame({"district_id": [*sums], "sums": [*sums.values()]})

    return run


def _solved(width: int):
    """Per district the combination of the searched space that comes next."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        both = np.sum(np.stack(group["sums"].to_list()), axis=0)
        m = int(round((len(both) / 2) ** 0.5))
        gram, h = both[: m * m].reshape(m, m), both[m * m :].reshape(m, m)
        scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
        values, turn = np.linalg.eigh(gram * scale[:, None] * scale)
        sound = values > 1e-10 * values.max()
        basis = scale[:, None] * turn[:, sound] / np.sqrt(values[sound])
        inner = basis.T @ ((h + h.T) / 2) @ basis
        lam, y = np.linalg.eigh(inner)
        lam, y = lam[::-1][:width], y[:, ::-1][:, :width]
        c = np.zeros((m, width))
        c[:, : y.shape[1]] = basis @ y
        lam = np.pad(lam, (0, width - len(lam)), constant_values=np.nan)
        return pd.DataFrame({"district_id": [int(group["district_id"].iloc[0])], "c": [c.ravel()], "next": [lam]})

    return run


def _moved(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.itertuples():
                k, mk = _sides(row, width)
                c = np.asarray(row.c).reshape(k.shape[1], width)
                step = c.copy()
                step[:width] = 0  # the part that left the present vectors
                first = len(row.mx) == 0
                p, mp = (np.zeros(0), np.zeros(0)) if first else ((k @ step).ravel(), (mk @ step).ravel())
                lam = np.nan_to_num(np.asarray(row.next))
                out.append((row.district_id, row.b, row.ids, row.d, row.top, (k @ c).ravel(), (mk @ c).ravel(), p, mp, lam))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in VECTORS.split(", ")])

    return run


def leading(tiles: Tiles, nodes: DataFrame, kind: str, width: int, rounds: int = ROUNDS, wanted: int | None = None) -> DataFrame:
    """Blocks of vectors (columns VECTORS): ``x`` holds by rows the leading
    eigenvectors of the normalised affinity, or of ``top`` - Laplacian, with their
    values in ``lam`` (0 where a district has fewer).  Ends when the first
    ``wanted`` values of every district have settled."""
    tops = nodes.groupBy("district_id").agg((2 * F.max("degree")).alias("top"))
    entry = F.array_sort(F.collect_list(F.struct("node", "degree")))
    blocks = nodes.groupBy("district_id", "b").agg(entry.alias("e")).join(tops, "district_id")
    plain = blocks.select("district_id", "b", F.col("e.node").alias("ids"), F.col("e.degree").alias("d"), "top")
    vectors = cut(plain.mapInPandas(_start(width), VECTORS))
    before: dict = {}
    for _ in range(rounds):
        searched = cut(_multiplied(tiles, vectors, kind, width))
        sums = searched.mapInPandas(_moments(width), "district_id long, sums array<double>")
        solved = cut(sums.groupBy("district_id").applyInPandas(_solved(width), "district_id long, c array<double>, next array<double>"))
        vectors = cut(searched.join(solved, "district_id").mapInPandas(_moved(width), VECTORS))
        # a few numbers a district
        now = {r.district_id: np.nan_to_num(np.array(r.next, float))[: wanted or width] for r in solved.select("district_id", "next").collect()}
        if not now or before and all(np.abs(v - before[k]).max() <= SETTLED * max(1.0, np.abs(v).max()) for k, v in now.items()):
            break
        before = now
    return vectors


def gap_clusters(vectors: DataFrame, nodes: DataFrame, most: int = 15, least: int = 2) -> DataFrame:
    """(district_id, k): clusters by the largest gap of the Laplacian's smallest eigenvalues."""
    values = vectors.groupBy("district_id").agg(F.first("lam").alias("lam"), F.first("top").alias("top"))
    sized = values.join(nodes.groupBy("district_id").agg(F.count("*").alias("n")), "district_id")
    top = F.least(F.lit(most), F.col("n") - 1).cast("int")
    gaps = F.transform(F.sequence(F.lit(1), top), lambda k: F.struct((F.get("lam", k - 1) - F.get("lam", k)).alias("gap"), (-k).alias("neg")))
    return sized.select("district_id", F.when(F.col("n") <= 2, F.col("n")).otherwise(F.least(F.greatest(-F.array_max(gaps)["neg"], F.lit(least)), top)).cast("int").alias("k"))


def embedded(vectors: DataFrame, clusters: DataFrame, width: int) -> DataFrame:
    """(district_id, node, k, x): a node's place by the first k eigenvectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.itertuples():
                x = np.asarray(row.x).reshape(-1, width)[:, : row.k] * _root(row.d)
                out += [(row.district_id, int(i), row.k, v) for i, v in zip(row.ids, x, strict=True)]
            if out:
                yield pd.DataFrame(out, columns=["district_id", "node", "k", "x"])

    return vectors.select("district_id", "ids", "d", "x").join(clusters, "district_id").mapInPandas(run, "district_id long, node long, k int, x array<double>")


def _gap(x, y):
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def nearest_centres(points: DataFrame, rounds: int = 50) -> DataFrame:
    """(district_id, node, c) of k-means by district: the first centre is the point
    farthest from the mean, each further one the farthest from those chosen; then
    means of the nearest points until no centre moves."""
    points = cut(points)
    sizes = points.select("district_id", "k").distinct()
    spread = points.select("district_id", F.posexplode("x").alias("place", "v")).groupBy("district_id", "place").agg(F.avg("v").alias("v"))
    in_order = lambda df, *by: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("e")).withColumn("m", F.col("e.v")).drop("e")
    centres = cut(in_order(spread, "district_id").select("district_id", F.array("m").alias("centres")))
    most = sizes.agg(F.max("k")).first()[0] or 0
    distance = F.array_min(F.transform("centres", lambda m: _gap(F.col("x"), m)))
    for chosen in range(most):
        # ties to the smallest node: the same centres in every run
        far = points.join(centres, "district_id").groupBy("district_id").agg(F.max(F.struct(F.round(distance, 12).alias("gap"), (-F.col("node")).alias("neg"), "x", "k")).alias("far"))
        grown = F.when(F.lit(chosen) >= F.col("far.k"), F.col("centres")).otherwise(F.concat("centres", F.array("far.x")))
        # the mean only led to the first centre
        centres = cut(centres.join(far, "district_id").select("district_id", F.array("far.x").alias("centres") if chosen == 0 else grown.alias("centres")))
    nearest = F.array_min(F.transform("centres", lambda m, c: F.struct(_gap(F.col("x"), m).alias("gap"), c.alias("c"))))["c"]
    for _ in range(rounds):
        own = points.join(centres, "district_id").select("district_id", "node", "x", nearest.alias("c"))
        means = in_order(own.select("district_id", "c", F.posexplode("x").alias("place", "v")).groupBy("district_id", "c", "place").agg(F.avg("v").alias("v")), "district_id", "c")
        new = means.groupBy("district_id").agg(F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias("by"))
        kept = F.transform("centres", lambda m, c: F.coalesce(F.element_at("by", c), m))
        moved = cut(centres.join(new, "district_id").select("district_id", kept.alias("new"), "centres"))
        step = F.array_max(F.zip_with("centres", "new", _gap))
        still = moved.where(step > 1e-16).limit(1).count()
        centres = moved.select("district_id", F.col("new").alias("centres"))
        if not still:
            break
    return points.join(centres, "district_id").select("district_id", "node", nearest.alias("c"))


def numbered_clusters(assigned: DataFrame) -> DataFrame:
    """(district_id, building_id, spectral_cluster): clusters numbered by their smallest node."""
    first = assigned.groupBy("district_id", "c").agg(F.min("node").alias("first"))
    # as many rows a district as it has clusters
    number = first.select("district_id", "c", (F.row_number().over(Window.partitionBy("district_id").orderBy("first")) - 1).cast("long").alias("spectral_cluster"))
    return assigned.join(number, ["district_id", "c"]).select("district_id", F.col("node").alias("building_id"), "spectral_cluster")


def block_clusters(affinities: DataFrame, clusters: int | None = None, most: int = 15, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(district_id, building_id, spectral_cluster) of districts of any size."""
    return clusters_by(*tiled(affinities, block), clusters, most, rounds)


def clusters_by(tiles: Tiles, nodes: DataFrame, clusters: int | None = None, most: int = 15, rounds: int = ROUNDS) -> DataFrame:
    """The same from tiles and their nodes (district_id, node, b, degree)."""
    if clusters is None:
        width = most + 3
        k = cut(gap_clusters(leading(tiles, nodes, LAPLACE, width, rounds, most + 1), nodes, most))
    else:
        k = nodes.groupBy("district_id").agg(F.least(F.count("*"), F.lit(clusters)).cast("int").alias("k"))
    wanted = k.agg(F.max("k")).first()[0] or 1
    width = wanted + 3
    found = leading(tiles, nodes, NORMAL, width, rounds, wanted)
    return numbered_clusters(nearest_centres(embedded(found, k, width)))


# The same where a district's nodes are one block: its rounds need no exchange


def _leading_of(matrix: np.ndarray, ids: np.ndarray, degree: np.ndarray, kind: str, width: int, rounds: int, wanted: int):
    """The row of ``leading`` of one block that is its whole district."""
    plain = pd.DataFrame({"district_id": [0], "b": [0], "ids": [ids], "d": [degree], "top": [2 * degree.max()]})
    vectors, before = next(_start(width)(iter([plain]))), None
    for _ in range(rounds):
        row = next(vectors.itertuples())
        w = _searched(row, width)
        total = matrix @ (w * _root(degree) if kind == NORMAL else w)
        mw = total * _root(degree) if kind == NORMAL else (row.top - degree)[:, None] * w + total
        searched = vectors.assign(w=[w.ravel()], mw=[mw.ravel()])
        solved = _solved(width)(next(_moments(width)(iter([searched]))))
        vectors = next(_moved(width)(iter([searched.assign(c=solved["c"], next=solved["next"])])))
        now = np.nan_to_num(np.asarray(solved["next"].iloc[0], float))[:wanted]
        if before is not None and np.abs(now - before).max() <= SETTLED * max(1.0, np.abs(now).max()):
            break
        before = now
    return next(vectors.itertuples())


def _nearest(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """``nearest_centres`` of the points of one district, in the order of their nodes."""
    gaps = lambda centres: ((x[:, None] - centres) ** 2).sum(2)
    # the first of the farthest is the one of the smallest node
    centres = x[[np.argmax(np.round(gaps(x.mean(0)[None])[:, 0], 12))]]
    while len(centres) < k:
        centres = np.vstack([centres, x[np.argmax(np.round(gaps(centres).min(1), 12))]])
    for _ in range(rounds):
        own = gaps(centres).argmin(1)
        new = np.stack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        step, centres = ((new - centres) ** 2).sum(1).max(), new
        if step <= 1e-16:
            break
    return gaps(centres).argmin(1)


def block_labels(matrix: np.ndarray, ids: np.ndarray, clusters: int | None = None, most: int = 15, least: int = 2, rounds: int = ROUNDS) -> np.ndarray:
    """Clusters of one district, as ``clusters_by`` finds and numbers them; ``ids`` ascend."""
    n, degree = len(ids), matrix.sum(1)
    if clusters is not None:
        k = min(n, clusters)
    elif n <= 2:
        k = n
    else:
        top = min(most, n - 1)
        lam = np.asarray(_leading_of(matrix, ids, degree, LAPLACE, most + 3, rounds, most + 1).lam)
        k = min(max(int(np.argmax(lam[:top] - lam[1 : top + 1])) + 1, least), top)
    row = _leading_of(matrix, ids, degree, NORMAL, k + 3, rounds, k)
    own = _nearest(np.asarray(row.x).reshape(-1, k + 3)[:, :k] * _root(degree), k)
    _, first, number = np.unique(own, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[number]
