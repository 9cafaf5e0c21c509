"""Language-model scores by a weighted backoff automaton.

Counts of words, word pairs and triples are taken over all training documents.
Each order is smoothed toward the one below: with h a context and h' the same
without its first word, ``p(w | h) = (c(h w) + K p(w | h')) / (c(h) + K)``, down to
the add-one unigram.  As an automaton:

- states: the root, a state for each word seen in training (and the start mark),
  and one for each pair seen there at least LEAST times;
- arcs: from a state by each word seen after its context, with log10 p; the root has
  an arc for each word and one for all unknown words;
- failure arcs: from a state to that of the shorter context, with log10 K / (c(h) + K).

A text is one left-to-right walk from the start mark's state.  The walk carries the
state, adds the weights of the failure arcs that it takes until a state has an arc
for the next word, adds that arc's weight, and goes to the state of the longest
context that exists; the last token is the end mark.

The model grows with the corpus and is never gathered in one place.  Texts form
blocks by a hash of their rows.  A block sends its distinct n-grams, with its training
counts, to the fragment of each n-gram's hash; fragments add them up, and each block
gets the totals of its own n-grams back: the part of the automaton that its texts can
reach.  Words and pairs go first, then the triples that start with a state.  A frequent
word or pair is one n-gram among others in its fragment, one entry a block.  What a
block holds depends on its rows only, so all passes agree however tasks are cut, also
after an executor was lost.

N-grams are 64-bit hashes.  Defined results: a null or empty text is one end token;
without training rows N, V and all counts are 0; repeated rows count as often as they
stand; very long texts are walked whole; other columns don't matter; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbering, cut, fold_of, hash64, mix, pack7, pack_counts, release, unpack7, unpack_counts, utf8

#: Hashes of the start and end marks: they hold spaces, so they are no words.
START, END = hash64(b" start "), hash64(b" end ")
BLOCK_BYTES = 12 << 20
#: Text bytes that a fragment stands for, and the least number of fragments: with 256, what is left of a hash has seven bytes.
FRAGMENT_BYTES, LEAST_FRAGMENTS = 12 << 20, 256
#: Training occurrences that make a pair a state, and K of the contexts of one and two words.
LEAST, STRENGTH = 2, (2.0, 1.0)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

ASK = "fragment int, block long, n_words int, grams binary, counts binary"
TOLD = "block long, fragment int, counts binary, n_types long, n_tokens long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


class Block:
    """Texts as numbers.  ``words`` has the sorted hashes of the distinct words and
    both marks, ``ids`` the places of all tokens in it (each text's end mark last),
    ``begin`` where each text starts; ``pair`` numbers the distinct pairs of a token
    and the one before, whose words are ``first`` and ``second``."""

    def __init__(self, texts: list[bytes]):
        number, lengths, out = Numbering(), [], []
        for text in texts:
            own = text.lower().split()
            lengths.append(len(own) + 1)
            out.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
            out.append(np.array([-2], np.int32))
        hashes = np.fromiter(map(hash64, number), np.uint64, len(number))
        self.words, place = np.unique(np.append(hashes, np.array([END, START], np.uint64)), return_inverse=True)
        place = place.astype(np.int32)
        del number, hashes
        self.ids = place[np.concatenate(out)] if out else np.zeros(0, np.int32)  # -2 is the end mark
        del out
        self.end, self.start = int(place[-2]), int(place[-1])
        self.lengths = np.array(lengths, np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[self.begin] = self.start
        keys, self.pair = _numbered(_key(before, len(self.words), self.ids))
        self.first, self.second = (keys // len(self.words)).astype(np.int32), (keys % len(self.words)).astype(np.int32)

    @property
    def pairs(self) -> np.ndarray:
        return _longer(self.words[self.first], self.words[self.second])

    def triples(self, pair_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each token's triple, -1 where no state of two words is before it;
        keys pair * words + word of the distinct triples)."""
        before = np.full(len(self.ids), -1, np.int32)
        before[1:] = self.pair[:-1]
        before[self.begin] = -1
        on = (before >= 0) & (pair_n >= LEAST)[before]  # the last pair stands in for none
        keys, number = _numbered(_key(before[on], len(self.words), self.ids[on]))
        before.fill(-1)
        before[on] = number
        return before, keys

    def triple_grams(self, keys: np.ndarray) -> np.ndarray:
        return _longer(self.pairs[keys // len(self.words)], self.words[keys % len(self.words)])


def _key(high: np.ndarray, size: int, low: np.ndarray) -> np.ndarray:
    """One number of two, the second below ``size``."""
    key = high.astype(np.int64)
    key *= size
    key += low
    return key


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with the inverse in 32 bits: a block has far fewer tokens."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], number


def _longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their contexts and last words."""
    with np.errstate(over="ignore"):
        return mix(context * _MULTIPLIER + word)


def _by_fragment(grams: np.ndarray, fragments: int) -> list[np.ndarray]:
    """Places of the n-grams of each fragment."""
    own = (grams % np.uint64(fragments)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    return np.split(order, np.searchsorted(own[order], np.arange(1, fragments)))


def _asked(key: tuple, fragments: int, words: np.ndarray, word_n: np.ndarray, grams: np.ndarray, gram_n: np.ndarray) -> pa.Table:
    """A block's messages: to each fragment its words, then its longer n-grams."""
    both = zip(_by_fragment(words, fragments), _by_fragment(grams, fragments), strict=True)
    own = [(f, w, g) for f, (w, g) in enumerate(both) if len(w) + len(g)]
    return pa.table(
        {
            "fragment": pa.array([f for f, _, _ in own], pa.int32()),
            "block": pa.array([key[0].as_py()] * len(own), pa.int64()),
            "n_words": pa.array([len(w) for _, w, _ in own], pa.int32()),
            "grams": pa.array([pack7(np.concatenate([words[w], grams[g]]) // np.uint64(fragments)) for _, w, g in own], pa.binary()),
            "counts": pa.array([pack_counts(np.concatenate([word_n[w], gram_n[g]])) for _, w, g in own], pa.binary()),
        }
    )


def _texts(group: pa.Table) -> list[bytes]:
    return [text for batch in group.select(["text"]).to_batches() for text in utf8(batch)]


def _trained(block: Block, texts: pa.Table) -> np.ndarray:
    """Whether each token belongs to a training text."""
    return np.repeat(~np.array(texts["held_out"].to_pylist(), bool), block.lengths)


def _ask_pairs(fragments: int):
    def asked(key: tuple, texts: pa.Table) -> pa.Table:
        block = Block(_texts(texts))
        token = _trained(block, texts)
        word_n = np.bincount(block.ids[token], minlength=len(block.words))
        word_n[block.start] = (~np.array(texts["held_out"].to_pylist(), bool)).sum()
        pair_n = np.bincount(block.pair[token], minlength=len(block.first))
        return _asked(key, fragments, block.words, word_n, block.pairs, pair_n)

    def run(key: tuple, texts: pa.Table) -> pa.Table:
        out = asked(key, texts)
        release()  # else workers keep what their largest block took, beside the JVM
        return out

    return run


def _totals(block: Block, told: pa.Table, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a block's words and pairs."""
    counts, pair_n = np.zeros(len(block.words), np.int64), np.zeros(len(block.first), np.int64)
    words, pairs = _by_fragment(block.words, fragments), _by_fragment(block.pairs, fragments)
    for fragment, blob in zip(told["fragment"].to_pylist(), told["counts"].to_pylist(), strict=True):
        w, p = words[fragment], pairs[fragment]
        both = unpack_counts(blob, len(w) + len(p))
        counts[w], pair_n[p] = both[: len(w)], both[len(w) :]
    return counts, pair_n


def _ask_triples(fragments: int):
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def asked(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(_texts(texts))
        number, keys = block.triples(_totals(block, told, fragments)[1])
        own = number[_trained(block, texts) & (number >= 0)]
        return _asked(key, fragments, *none, block.triple_grams(keys), np.bincount(own, minlength=len(keys)))

    def run(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        out = asked(key, texts, told)
        release()
        return out

    return run


def _add_up(fragments: int):
    start = START // fragments

    def totals_of(group: pa.Table) -> pa.Table:
        """One fragment: totals of its n-grams, told to each block that asked."""
        grams = [unpack7(blob) for blob in group["grams"].to_pylist()]
        counts = [unpack_counts(blob, len(g)) for blob, g in zip(group["counts"].to_pylist(), grams, strict=True)]
        n_words = group["n_words"].to_pylist()
        totals = [np.zeros(len(g), np.int64) for g in grams]
        n_types = n_tokens = 0
        for words in (True, False):
            parts = [slice(0, n) if words else slice(n, None) for n in n_words]
            all_grams = np.concatenate([g[p] for g, p in zip(grams, parts, strict=True)])
            distinct, number = np.unique(all_grams, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, number, np.concatenate([c[p] for c, p in zip(counts, parts, strict=True)]))
            at = 0
            for out, p, g in zip(totals, parts, grams, strict=True):
                size = len(g[p])
                out[p] = total[number[at : at + size]]
                at += size
            if words:
                fragment = group["fragment"][0].as_py()
                own = total[(distinct != np.uint64(start)) | (fragment != START % fragments)]
                n_types, n_tokens = int((own > 0).sum()), int(own.sum())
        head = [i == 0 for i in range(len(grams))]  # the fragment's own numbers are on its first row
        return pa.table(
            {
                "block": group["block"],
                "fragment": group["fragment"],
                "counts": pa.array([pack_counts(t) for t in totals], pa.binary()),
                "n_types": pa.array([n_types if h else 0 for h in head], pa.int64()),
                "n_tokens": pa.array([n_tokens if h else 0 for h in head], pa.int64()),
            }
        )

    def run(group: pa.Table) -> pa.Table:
        out = totals_of(group)
        release()
        return out

    return run


class BackoffAutomaton:
    """The part of the automaton that a block can reach, with log10 weights.

    States are numbers: 0 is the root, 1 + i word i, 1 + words + p pair p.
    ``failure[s]`` and ``failure_weight[s]`` are a state's failure arc; arcs are held by
    the n-gram that they read: ``arc1`` by word, ``arc2`` by pair, ``arc3`` by triple,
    nan where nothing was seen; ``after[p]`` is the state after reading pair p."""

    def __init__(self, block: Block, counts: np.ndarray, pair_n: np.ndarray, triples: np.ndarray, triple_n: np.ndarray, n_tokens: int, n_types: int, strength: tuple[float, float] = STRENGTH):
        k1, k2 = strength
        self.n_words, words = len(block.words), len(block.words)
        self.start = 1 + block.start if counts[block.start] > 0 else 0
        self.arc1 = np.log10((counts + 1.0) / (n_tokens + 1.0 * (n_types + 1)))
        word_state = np.where(counts > 0, 1 + np.arange(words), 0)
        pair_state = np.where(pair_n >= LEAST, 1 + words + np.arange(len(pair_n)), word_state[block.second])
        self.after = pair_state
        self.failure = np.concatenate([[0], np.zeros(words, np.int64), word_state[block.second]])
        self.failure_weight = np.concatenate([[0.0], np.log10(k1 / (counts + k1)), np.log10(k2 / (pair_n + k2))])
        with np.errstate(divide="ignore"):
            p2 = (pair_n + k1 * 10.0 ** self.arc1[block.second]) / (counts[block.first] + k1)
            self.arc2 = np.where(pair_n > 0, np.log10(p2), np.nan)
            # a triple's last two words are a pair of the block
            context, last = triples // words, triples % words
            keys = _key(block.first, words, block.second)
            shorter = np.searchsorted(keys, _key(block.second[context], words, last)) if len(triples) else np.zeros(0, np.int64)
            p3 = (triple_n + k2 * p2[shorter]) / (pair_n[context] + k2)
            self.arc3 = np.where(triple_n > 0, np.log10(p3), np.nan)

    def step(self, state: np.ndarray, word: np.ndarray, pair: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, next state) of reading a token in each of several walks."""
        weight, state = np.zeros(len(state)), state.copy()
        open_ = state > self.n_words
        found = np.full(len(state), np.nan)
        known = open_ & (triple >= 0)
        found[known] = self.arc3[triple[known]]
        state, weight = self._failed(open_ & np.isnan(found), state, weight)
        open_ = np.isnan(found) & (state > 0)
        found[open_] = self.arc2[pair[open_]]
        state, weight = self._failed(open_ & np.isnan(found), state, weight)
        return weight + np.where(np.isnan(found), self.arc1[word], found), self.after[pair]

    def _failed(self, which: np.ndarray, state: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight[which] += self.failure_weight[state[which]]
        state[which] = self.failure[state[which]]
        return state, weight


def walk(block: Block, automaton: BackoffAutomaton, triple: np.ndarray) -> np.ndarray:
    """log10 probability of each text: all walks go on together, a token at a time."""
    order = np.argsort(-block.lengths, kind="stable")
    begin, lengths = block.begin[order], block.lengths[order]
    state, score = np.full(len(order), automaton.start), np.zeros(len(order))
    active = len(order)
    for t in range(int(lengths[0]) if active else 0):
        active = int(np.searchsorted(-lengths, -t, side="left"))  # walks with a token left
        at = begin[:active] + t
        weight, state[:active] = automaton.step(state[:active], block.ids[at], block.pair[at], triple[at])
        score[:active] += weight
    out = np.empty(len(order))
    out[order] = score
    return out


def _scores(fragments: int, n_tokens: int, n_types: int, strength: tuple[float, float]):
    def scores(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(_texts(texts))
        longer = np.array(told["longer"].to_pylist(), bool)
        counts, pair_n = _totals(block, told.filter(pa.array(~longer)), fragments)
        triple, keys = block.triples(pair_n)
        triple_n = np.zeros(len(keys), np.int64)
        places = _by_fragment(block.triple_grams(keys), fragments)
        own = told.filter(pa.array(longer))
        for fragment, blob in zip(own["fragment"].to_pylist(), own["counts"].to_pylist(), strict=True):
            triple_n[places[fragment]] = unpack_counts(blob, len(places[fragment]))
        automaton = BackoffAutomaton(block, counts, pair_n, keys, triple_n, n_tokens, n_types, strength)
        add = lambda x: np.add.reduceat(x, block.begin) if len(block.begin) else x
        return pa.table(
            {
                "doc_id": texts["doc_id"],
                "held_out": texts["held_out"],
                "n_tokens": block.lengths,
                "n_known": add((counts[block.ids] > 0).astype(np.int64)),
                "base_score": add(automaton.arc1[block.ids]),
                "score": walk(block, automaton, triple),
            }
        )

    def run(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        out = scores(key, texts, told)
        release()
        return out

    return run


def score_texts(documents: DataFrame, folds: int, held_out: int, strength: tuple[float, float] = STRENGTH) -> DataFrame:
    """A row for each document: tokens, known tokens, base and model scores."""
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    size = size["b"] + 16 * size["n"]
    blocks, fragments = max(8, -(-size // BLOCK_BYTES)), max(LEAST_FRAGMENTS, -(-size // FRAGMENT_BYTES))
    held = (fold_of("doc_id", folds) == held_out).alias("held_out")
    rows = documents.select("doc_id", held, F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    added = lambda asked: cut(asked.groupBy("fragment").applyInArrow(_add_up(fragments), TOLD))
    told = added(rows.groupBy("block").applyInArrow(_ask_pairs(fragments), ASK))
    whole = told.agg(F.coalesce(F.sum("n_types"), F.lit(0)).alias("v"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()
    totals = told.select("block", "fragment", "counts")
    longer = added(rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_ask_triples(fragments), ASK)).select("block", "fragment", "counts")
    both = totals.withColumn("longer", F.lit(False)).unionByName(longer.withColumn("longer", F.lit(True)))
    scored = rows.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_scores(fragments, whole["n"], whole["v"], strength), SCORED)
    return scored.withColumn("train_tokens", F.lit(whole["n"]).cast("long"))
