"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes a hashed term vector: words, and terms for its shape (marks at
word ends, capitals, repeats, lone bars, lines).  Both families are weighted by
sublinear frequency and inverse document frequency and brought to unit length,
then projected on the leading singular vectors of the training sample.  The
sample's latent vectors and labels are broadcast; every document's exact cosines
against all of them are computed in blocks, and its NEIGHBOURS nearest vote with
their similarity as weight.

The fit uses at most SAMPLE training rows of each class (a documented bound, so
what is broadcast is bounded: 2 * SAMPLE * RANK + TERMS * RANK floats).  Defined
results: null and empty texts have a zero vector, no positive similarity, and
score the sample's share of label 1; without labels every score is 0.5; ties
among neighbours go to the smaller doc_id; of rows that repeat a doc_id the least
text and the least label count in the fit, and each row is scored; very long texts
are read whole; other columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import filtered, hash64, labelled_sample, releasing, scored, utf8

TERMS, SHAPES = 1 << 14, 1 << 8
SAMPLE, RANK, NEIGHBOURS = 2500, 64, 15
#: Weight of the family of shape terms against that of words.
SHAPE_WEIGHT = 2.0
ROWS = 256  # of a block of cosines
#: Words that a task keeps the terms of.
CACHED = 100_000



class WordCache(dict):
    """word -> (word term, shape term), of frequent words; starts anew when it grows large."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > CACHED:
            self.clear()
        got = self[word] = (hash64(word.lower().strip(b".,;:!?\"'()[]{}#*$%&|<>")) % TERMS, hash64(shape_of(word)) % SHAPES)
        return got


def shape_of(word: bytes) -> bytes:
    """Capitals, digits and the closing marks of a word."""
    core = word.rstrip(b"!?.,;:#*$%&|<>-=_/\\")
    marks = word[len(core) :][:4]
    text = core.decode("utf-8", "replace")
    if not core:
        kind = b"0"
    elif any(c.isdigit() for c in text):
        kind = b"9"
    elif len(text) > 1 and text.isupper():
        kind = b"A"
    elif text[:1].isupper():
        kind = b"Aa"
    else:
        kind = b"a"
    return kind + b" " + (marks if len(set(marks)) > 1 or len(marks) < 2 else marks[:1] + b"+")


def features(text: bytes, cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """(terms, counts): words below TERMS, shapes from TERMS on."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    both = np.array([cache[w] for w in words], np.int64)
    shapes = both[:, 1] + TERMS
    # a word equal to the one before, and a line equal to an earlier one, are shapes as well
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    extra = np.array([TERMS + SHAPES] * again + [TERMS + SHAPES + 1] * dup, np.int64)
    return np.unique(np.concatenate([both[:, 0], shapes, extra]), return_counts=True)


WIDTH = TERMS + SHAPES + 2


@dataclass
class LatentVoter:
    idf: np.ndarray
    project: np.ndarray  # WIDTH x RANK
    vectors: np.ndarray  # of the sample, unit length
    labels: np.ndarray

    def latent(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), self.project.shape[1]), np.float32)
        for i, (terms, counts) in enumerate(rows):
            if len(terms):
                out[i] = weigh(terms, counts, self.idf) @ self.project[terms]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def vote(self, latent: np.ndarray) -> np.ndarray:
        """Scores of a block: all its cosines, then the nearest neighbours' votes."""
        n = len(self.labels)
        if n == 0:
            return np.full(len(latent), 0.5)
        cosines = latent @ self.vectors.T
        k = min(NEIGHBOURS, n)
        # sample rows are in doc_id order, so a stable choice gives ties to the smaller doc_id
        kth = np.partition(cosines, n - k, axis=1)[:, n - k, None]
        above = cosines > kth
        room = k - above.sum(1, keepdims=True)
        level = cosines == kth
        near = above | (level & (np.cumsum(level, axis=1) <= room))
        weight = np.where(near, np.maximum(cosines, 0), 0).astype(np.float64)
        total = weight.sum(1)
        return np.where(total > 0, (weight @ self.labels) / np.where(total > 0, total, 1), self.labels.mean())

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> LatentVoter:
        df = np.zeros(WIDTH)
        for terms, _ in rows:
            df[terms] += 1
        idf = np.log((1 + len(rows)) / (1 + df)) + 1.0
        if not rows:
            return cls(idf, np.zeros((WIDTH, RANK), np.float32), np.zeros((0, RANK), np.float32), labels)
        # randomized truncated SVD: the sparse matrix is only ever multiplied by thin ones
        indptr = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])])
        terms = np.concatenate([t for t, _ in rows])
        values = np.concatenate([weigh(t, c, idf) for t, c in rows]).astype(np.float32)
        rank = min(RANK + 8, len(rows))

        def times(m: np.ndarray) -> np.ndarray:
            return np.stack([values[a:b] @ m[terms[a:b]] for a, b in zip(indptr, indptr[1:], strict=False)])

        def times_t(m: np.ndarray) -> np.ndarray:
            out = np.zeros((WIDTH, m.shape[1]), np.float32)
            for i, (a, b) in enumerate(zip(indptr, indptr[1:], strict=False)):
                out[terms[a:b]] += values[a:b, None] * m[i]
            return out

        q = np.linalg.qr(times(np.random.default_rng(seed).normal(size=(WIDTH, rank)).astype(np.float32)))[0]
        for _ in range(3):
            q = np.linalg.qr(times(np.linalg.qr(times_t(q))[0]))[0]
        _, _, vt = np.linalg.svd(times_t(q).T, full_matrices=False)
        voter = cls(idf, np.ascontiguousarray(vt[:RANK].T.astype(np.float32)), np.zeros((0, RANK), np.float32), labels.astype(np.float64))
        voter.vectors = voter.latent(rows)
        return voter


def weigh(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Words by sublinear frequency, shapes by their share; each family at unit length."""
    words = terms < TERMS
    v = np.where(words, (1 + np.log(counts)) * idf[terms], 0.0)
    s = np.where(words, 0.0, np.sqrt(counts / counts[words].sum()))
    nv, ns = np.linalg.norm(v), np.linalg.norm(s)
    return v / (nv or 1) + SHAPE_WEIGHT * s / (ns or 1)


@releasing
def fit_quality(documents: DataFrame, labels: DataFrame, folds: int, held_out: int, per_class: int = SAMPLE) -> LatentVoter:
    sample = labelled_sample(documents, labels, "quality", folds, held_out, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache()
        for batch in batches:
            both = [features(t, cache) for t in utf8(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([t.astype("<i4").tobytes() for t, _ in both], pa.binary()),
                    pa.array([c.astype("<i4").tobytes() for _, c in both], pa.binary()),
                    batch.column(2),
                ],
                names=["doc_id", "terms", "counts", "label"],
            )

    # at most 2 * per_class sparse vectors, in the order of doc_id
    got = sample.mapInArrow(run, "doc_id long, terms binary, counts binary, label int").toArrow().combine_chunks().sort_by("doc_id")
    rows = [(np.frombuffer(t, "<i4").astype(np.int64), np.frombuffer(c, "<i4").astype(float)) for t, c in zip(got["terms"].to_pylist(), got["counts"].to_pylist(), strict=True)]
    return LatentVoter.fit(rows, got["label"].to_numpy().astype(float))


def _scorer(model: LatentVoter):
    shared = SparkSession.active().sparkContext.broadcast(vars(model))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[float]]]:
        cache, voter = WordCache(), LatentVoter(**shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part, voter.vote(voter.latent([features(t, cache) for t in utf8(part)])).tolist()

    return scores


def score_quality(documents: DataFrame, model: LatentVoter) -> DataFrame:
    """(doc_id, score) of every document."""
    return scored(documents, _scorer(model))


def keep(documents: DataFrame, model: LatentVoter, limit: float) -> DataFrame:
    """The rows of ``documents``, with all their columns, that score ``limit`` or more."""
    return filtered(documents, _scorer(model), lambda s: s >= limit)
