"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased words and of their beginnings, hashed to
TERMS numbers.  The
machine has a weight and a short vector for each term that tells the classes
apart in training; the score is the logistic function of
``w0 + sum w_i + sum_{i<j} <v_i, v_j>``, so a pair such as an insult and a group
mention counts beyond its two terms.

The fit uses at most SAMPLE training rows of each class (a documented bound);
terms get a weight and a vector that are significantly more or less frequent in
one class, or alone or in a pair tell what the machine of those terms doesn't
know: a pair counts also if each of its terms is as frequent in both classes.
Without that test, with all terms in, the machine learns its training rows by heart.

Defined results: null and empty texts have no terms and score ``logistic(w0)``;
without labelled rows of both classes every text scores about the share of label
1 (about 0 without labels); of rows that repeat a doc_id the least text and the
least label count in the fit, and each row is scored; very long texts are read
whole; other columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import filtered, hash64, labelled_sample, releasing, scored, utf8

TERMS = 1 << 20
#: Letters of a word's beginning: inflected and compounded words share it.
BEGIN = 4
SAMPLE = 6000
RANK, ROUNDS, BATCH, RATE, DECAY = 6, 30, 16, 0.1, 1e-4
#: Documents that must hold a term, and how many standard errors its rate must differ by.
MIN_DOCUMENTS, MIN_Z = 4, 5.0
#: The same of a pair of terms, against what the machine of the terms above expects of its documents.
PAIR_DOCUMENTS, PAIR_Z = 20, 6.5
#: The least variance of a document's label that is assumed.
MIN_SPREAD = 1e-3
#: Words that a task keeps the terms of.
CACHED = 100_000
#: Terms whose pairs are tried at a time.
PAIR_BLOCK = 256
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class TermCache(dict):
    """word -> hashed terms of the word and of its beginning; starts anew when it grows large."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > CACHED:
            self.clear()
        begin = word.decode("utf-8", "replace")[:BEGIN].encode()
        got = self[word] = (hash64(word) % TERMS, hash64(begin + b"*") % TERMS)
        return got


def terms_of(text: bytes, cache: TermCache) -> np.ndarray:
    words = set(_WORD.findall(text.lower()))
    return np.unique(np.fromiter(chain.from_iterable(map(cache.__getitem__, words)), np.int64, 2 * len(words)))


@dataclass
class FactorizationMachine:
    """``index[term]`` is the row of a term in ``weights`` and ``vectors``, -1 without one."""

    index: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margin(self, rows: np.ndarray) -> float:
        if not len(rows):
            return self.bias
        v = self.vectors[rows]
        s = v.sum(0)
        return float(self.bias + self.weights[rows].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, terms: np.ndarray) -> float:
        rows = self.index[terms]
        return float(1.0 / (1.0 + np.exp(-np.clip(self.margin(rows[rows >= 0]), -30, 30))))

    @classmethod
    def fit(cls, samples: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> FactorizationMachine:
        index = np.full(TERMS, -1, np.int32)
        share = float(labels.mean()) if len(labels) else 0.0
        if share in (0.0, 1.0):
            bias = -30.0 if share == 0 else 30.0
            return cls(index, bias, np.zeros(0), np.zeros((0, RANK)))
        # equal term sets are one sample: a group of copies counts once
        first = {t.tobytes(): i for i, t in reversed(list(enumerate(samples)))}
        samples, labels = [samples[i] for i in sorted(first.values())], labels[sorted(first.values())]
        n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
        df = np.zeros((2, TERMS))
        for terms, y in zip(samples, labels, strict=True):
            df[int(y), terms] += 1
        both = (df[0] + df[1]) / (n0 + n1)
        z = np.abs(df[1] / n1 - df[0] / n0) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n0 + 1 / n1))
        z[df.sum(0) < MIN_DOCUMENTS] = 0
        chosen = np.flatnonzero(z >= MIN_Z)
        alone = cls._fitted(samples, labels, chosen, n1, n0, seed)
        p = np.array([alone.score(t) for t in samples])
        more = _in_pairs(samples, labels - p, p * (1 - p), df.sum(0))
        both = np.union1d(chosen, more)
        return alone if len(both) == len(chosen) else cls._fitted(samples, labels, both, n1, n0, seed)

    @classmethod
    def _fitted(cls, samples: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray, n1: int, n0: int, seed: int) -> FactorizationMachine:
        index = np.full(TERMS, -1, np.int32)
        index[chosen] = np.arange(len(chosen), dtype=np.int32)
        rng = np.random.default_rng(seed)
        w, v, b = np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), RANK)), float(np.log(n1 / n0))
        gw, gv, gb = np.full(len(chosen), 1e-6), np.full((len(chosen), RANK), 1e-6), 1e-6
        rows = [r[r >= 0] for r in (index[t] for t in samples)]
        for _ in range(ROUNDS):  # Adagrad, a batch of samples at a time
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                own = order[at : at + BATCH]
                x = np.zeros((len(own), len(chosen)))
                for i, k in enumerate(own):
                    x[i, rows[k]] = 1
                s = x @ v
                margin = b + x @ w + 0.5 * ((s * s).sum(1) - x @ (v * v).sum(1))
                g = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[own]
                held, told = x.sum(0), g @ x
                gb += g.sum() ** 2
                b -= RATE * g.sum() / np.sqrt(gb)
                dw = told + DECAY * held * w
                gw += dw * dw
                w -= RATE * dw / np.sqrt(gw)
                dv = x.T @ (g[:, None] * s) - told[:, None] * v + DECAY * held[:, None] * v
                gv += dv * dv
                v -= RATE * dv / np.sqrt(gv)
        return cls(index, b, w, v)


def _in_pairs(samples: list[np.ndarray], rest: np.ndarray, spread: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Terms of the pairs (of a term with itself too) whose documents' labels differ
    from what is expected: ``rest`` is that difference, ``spread`` its variance."""
    spread = np.maximum(spread, MIN_SPREAD)
    # no pair's difference exceeds the sum of |rest| over the documents of either term; where that is at
    # most 1/2 everywhere, the variance of a document is at least half of it
    off, wrong = np.zeros(TERMS), np.zeros(TERMS, bool)
    for terms, r in zip(samples, np.abs(rest), strict=True):
        off[terms] += r
        wrong[terms] |= r > 0.5
    least = np.where(wrong, PAIR_Z * np.sqrt(PAIR_DOCUMENTS * MIN_SPREAD), PAIR_Z**2 / 2)
    tried = np.flatnonzero((df >= PAIR_DOCUMENTS) & (off >= least))
    place = np.full(TERMS, -1, np.int32)
    place[tried] = np.arange(len(tried))
    own = [place[t][place[t] >= 0] for t in samples]
    row = np.repeat(np.arange(len(samples), dtype=np.int32), [len(x) for x in own])
    column = np.concatenate(own) if own else np.zeros(0, np.int32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]

    def block(at: int) -> np.ndarray:
        own = slice(*np.searchsorted(column, [at, at + PAIR_BLOCK]))
        out = np.zeros((min(PAIR_BLOCK, len(tried) - at), len(samples)), np.float32)
        out[column[own] - at, row[own]] = 1
        return out

    telling = np.zeros(len(tried), bool)
    for a in range(0, len(tried), PAIR_BLOCK):
        x = block(a)
        differ, noise = x * rest.astype(np.float32), x * spread.astype(np.float32)
        for b in range(a, len(tried), PAIR_BLOCK):
            y = block(b).T
            found = np.abs(differ @ y) >= PAIR_Z * np.sqrt(noise @ y)
            if not found.any():
                continue
            found &= x @ y >= PAIR_DOCUMENTS
            telling[a : a + PAIR_BLOCK] |= found.any(1)
            telling[b : b + PAIR_BLOCK] |= found.any(0)
    return tried[telling]


@releasing
def fit_toxicity(documents: DataFrame, labels: DataFrame, folds: int, held_out: int, per_class: int = SAMPLE) -> FactorizationMachine:
    sample = labelled_sample(documents, labels, "toxic", folds, held_out, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TermCache()
        for batch in batches:
            terms = [terms_of(t, cache).astype("<i4").tobytes() for t in utf8(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary()), batch.column(2)], names=["doc_id", "terms", "label"])

    # at most 2 * per_class sets, of four bytes a term, in one piece of memory
    got = sample.mapInArrow(run, "doc_id long, terms binary, label int").toArrow().combine_chunks().sort_by("doc_id")
    return FactorizationMachine.fit([np.frombuffer(t.as_buffer(), "<i4") if t.as_buffer().size else np.zeros(0, "<i4") for t in got["terms"]], got["label"].to_numpy().astype(float))


def _scorer(model: FactorizationMachine):
    shared = SparkSession.active().sparkContext.broadcast(vars(model))  # TERMS numbers and at most as many rows

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[float]]]:
        cache, machine = TermCache(), FactorizationMachine(**shared.value)
        for batch in batches:
            yield batch, [machine.score(terms_of(t, cache)) for t in utf8(batch)]

    return scores


def score_toxicity(documents: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, score) of every document."""
    return scored(documents, _scorer(model))


def keep(documents: DataFrame, model: FactorizationMachine, limit: float) -> DataFrame:
    """The rows of ``documents``, with all their columns, that score below ``limit``."""
    return filtered(documents, _scorer(model), lambda s: s < limit)
