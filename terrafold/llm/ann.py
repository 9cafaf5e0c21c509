"""Approximate maximum inner product search with anisotropic quantisation.

A vector is cut into pairs of components and each pair is coded by one of 16
centres (four bits).  Codes and centres minimise a score-aware loss: the part of
the residual parallel to the vector counts ``ETA`` times the part across it,
because only the former moves the inner products that matter.  A search adds up
a table of 16 products per pair and query over all codes; the best RERANK of
each block of rows are ranked again by exact inner products in double precision.

Centres are fitted on at most SAMPLE vectors (a documented bound); every row is
coded once, and the blocks of codes are written with their vectors.  Queries go in
blocks of QUERY_BLOCK, broadcast one block at a time; each scans the written codes.
Defined results: vectors that are null, of another length than most of the sample,
zero, or hold null or non-finite components take no part; ties go to the smaller
vec_id; each repeated row is a candidate of its own; a query's vec_id is asked once
(with different vectors, the least); with fewer candidates than k all are returned; an
empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

CENTRES = 16
SAMPLE, QUERY_BLOCK, ROW_BLOCK, RERANK = 10_000, 4096, 8192, 120
#: Rows of a block that are ranked again, for each one asked for, where that's more than RERANK.
RERANK_SHARE = 6
#: Inner products above this share of the largest possible are those that matter.
THRESHOLD = 0.2


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v double array) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    return (
        vectors.select("vec_id", v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    )


@dataclass
class Codebook:
    """``centres[m, j]`` is centre j of pair m; ``eta`` the weight of parallel error."""

    centres: np.ndarray  # pairs x 16 x 2
    eta: float

    @property
    def pairs(self) -> int:
        return len(self.centres)

    def _cut(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), 2 * self.pairs))
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), self.pairs, 2)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (n x pairs): start at the nearest centres, then change one pair
        at a time to whatever lessens the anisotropic loss."""
        cut = self._cut(x)
        unit = cut / np.linalg.norm(x, axis=1)[:, None, None]
        # residual of each centre, its square and its part along the vector
        codes = np.empty((len(x), self.pairs), np.uint8)
        square = np.empty((self.pairs, len(x), CENTRES), np.float32)
        along = np.empty((self.pairs, len(x), CENTRES), np.float32)
        for m in range(self.pairs):
            r = cut[:, m, None, :] - self.centres[m]
            square[m] = (r * r).sum(2)
            along[m] = (r * unit[:, m, None, :]).sum(2)
            codes[:, m] = square[m].argmin(1)
        rows = np.arange(len(x))
        total = sum(along[m][rows, codes[:, m]] for m in range(self.pairs))
        for _ in range(sweeps):
            for m in range(self.pairs):
                rest = total - along[m][rows, codes[:, m]]
                loss = square[m] + (self.eta - 1) * (rest[:, None] + along[m]) ** 2
                codes[:, m] = loss.argmin(1)
                total = rest + along[m][rows, codes[:, m]]
        return codes

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 6, seed: int = 3) -> Codebook:
        d = x.shape[1]
        eta = (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2) if d > 1 else 1.0
        book = cls(np.zeros(((d + 1) // 2, CENTRES, 2)), max(1.0, eta))
        cut, rng = book._cut(x), np.random.default_rng(seed)
        for m in range(book.pairs):  # k-means on each pair
            c = cut[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), m]
            for _ in range(10):
                near = ((cut[:, m, None] - c) ** 2).sum(2).argmin(1)
                for j in np.unique(near):
                    c[j] = cut[near == j, m].mean(0)
            book.centres[m] = c
        unit = cut / np.linalg.norm(x, axis=1)[:, None, None]
        for _ in range(rounds):  # codes for the centres, then centres for the codes
            codes = book.encode(x)
            rows = np.arange(len(x))
            residual = cut - np.stack([book.centres[m][codes[:, m]] for m in range(book.pairs)], 1)
            along = (residual * unit).sum((1, 2))
            for m in range(book.pairs):
                u, rest = unit[:, m], along - (residual[:, m] * unit[:, m]).sum(1)
                for j in np.unique(codes[:, m]):
                    own = rows[codes[:, m] == j]
                    uo = u[own]
                    # minimise sum |c_x - c|^2 + (eta-1) (rest + (c_x - c).u)^2 over c
                    a = len(own) * np.eye(2) + (book.eta - 1) * uo.T @ uo
                    t = rest[own] + (cut[own, m] * uo).sum(1)
                    b = cut[own, m].sum(0) + (book.eta - 1) * (t[:, None] * uo).sum(0)
                    book.centres[m, j] = np.linalg.solve(a, b)
                residual[:, m] = cut[:, m] - book.centres[m][codes[:, m]]
                along = rest + (residual[:, m] * unit[:, m]).sum(1)
        return book

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """pairs x 16 x queries products."""
        cut = self._cut(queries)
        return np.einsum("qmc,mjc->mjq", cut, self.centres).astype(np.float32)

    def scan(self, codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Approximate products (rows x queries): one table line a pair and row.
        Two four-bit tables at a time make one of 256 lines."""
        out = np.zeros((len(codes), tables.shape[2]), np.float32)
        for m in range(0, self.pairs - 1, 2):
            both = (tables[m][:, None] + tables[m + 1][None]).reshape(CENTRES * CENTRES, -1)
            out += both[codes[:, m].astype(np.int64) * CENTRES + codes[:, m + 1]]
        if self.pairs % 2:
            out += tables[-1][codes[:, -1]]
        return out


def fit_codebook(vectors: DataFrame, sample: int = SAMPLE) -> tuple[Codebook | None, int]:
    """The codebook and the vectors' length, from the rows first by a hash of vec_id."""
    got = usable(vectors).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not got:
        return None, 0
    sizes = [len(r.v) for r in got]
    size = max(set(sizes), key=lambda s: (sizes.count(s), -s))
    return Codebook.fit(np.array([r.v for r in got if len(r.v) == size])), size


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal vectors get equal ones."""
    return (queries * rows).sum(axis=-1)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _distinct(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct vectors, and the ids of each: in ``members`` from ``start`` on,
    ascending.  A vector that many rows share takes one place among the best."""
    _, first, group, count = np.unique(
        np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).reshape(-1), return_index=True, return_inverse=True, return_counts=True
    )
    members = ids[np.lexsort((ids, group.reshape(-1)))]
    return x[first], members, np.concatenate([[0], np.cumsum(count)[:-1]]), count


CODED = "members binary, counts binary, vectors binary, codes binary"
FOUND = "query_id long, vec_id long, score double"


def _code_blocks(book: Codebook):
    """Blocks of rows: ids of the distinct vectors' rows, how many each has, vectors and codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                x, members, _, count = _distinct(ids, x)
                blobs = (members.astype("<i8"), count.astype("<i8"), x.astype("<f8"), book.encode(x))
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for b in blobs], names=[c.split()[0] for c in CODED.split(", ")])

    return run


def _search_blocks(book: Codebook, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """A task's best k rows of each query."""
    tables = book.tables(queries)
    size = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_ids = [np.zeros(0, np.int64)] * len(query_ids)
        top_scores = [np.zeros(0)] * len(query_ids)
        for batch in batches:
            for members, counts, vectors, codes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                members, count = np.frombuffer(members, "<i8"), np.frombuffer(counts, "<i8")
                start = np.cumsum(count) - count
                x, codes = np.frombuffer(vectors, "<f8").reshape(-1, size), np.frombuffer(codes, np.uint8).reshape(-1, book.pairs)
                for q0 in range(0, len(query_ids), 256):
                    near = book.scan(codes, tables[:, :, q0 : q0 + 256])
                    want = min(max(RERANK, RERANK_SHARE * k), len(near))
                    kth = np.partition(near, len(near) - want, axis=0)[len(near) - want]
                    for j in range(near.shape[1]):
                        q = q0 + j
                        pick = np.flatnonzero(near[:, j] >= kth[j])
                        score = exact(queries[q], x[pick])
                        # each distinct vector stands for its rows of smallest vec_id, one more than asked
                        n = np.minimum(count[pick], k + 1)
                        own = np.concatenate([members[s : s + m] for s, m in zip(start[pick], n, strict=True)])
                        score = np.repeat(score, n)
                        other = own != query_ids[q]
                        all_ids = np.concatenate([top_ids[q], own[other]])
                        all_scores = np.concatenate([top_scores[q], score[other]])
                        keep = best(all_ids, all_scores, k)
                        top_ids[q], top_scores[q] = all_ids[keep], all_scores[keep]
        for at in range(0, len(query_ids), 512):
            own = [i for i in range(at, min(at + 512, len(query_ids))) if len(top_ids[i])]
            if own:
                asked = np.repeat(query_ids[own], [len(top_ids[i]) for i in own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked, pa.int64()), pa.array(np.concatenate([top_ids[i] for i in own])), pa.array(np.concatenate([top_scores[i] for i in own]))], names=["query_id", "vec_id", "score"]
                )

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` nearest rows."""
    spark = SparkSession.active()
    book, size = fit_codebook(vectors, sample)
    if book is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coded = cut(usable(vectors).where(F.size("v") == size).mapInArrow(_code_blocks(book), CODED))
    asked = cut(usable(queries).where(F.size("v") == size).groupBy("vec_id").agg(F.min("v").alias("v")))
    # query blocks by ranges of a hash, so that each is of bounded size however many there are
    blocks = max(1, -(-asked.count() // (QUERY_BLOCK // 2)))
    found = spark.createDataFrame([], FOUND)
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        if own.num_rows:
            x = own["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
            found = found.unionByName(coded.mapInArrow(_search_blocks(book, own["vec_id"].to_numpy(), x, k), FOUND))
    # tasks' best rows are sorted, cut to k before the shuffle and again behind it, never gathered
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
