"""Audit of how the word use of sources diverges within a language.

1. First pass: blocks of texts of one language write their texts (letters kept,
   all else a space) by source, and the documents of each distinct term.  Sums
   over blocks are exact document frequencies; terms of enough documents are kept.
2. Second pass: a block's kept terms, padded with delimiters, become an automaton
   (Aho-Corasick) that recounts all their occurrences by source.  No automaton
   holds more than the terms of its own block.
3. Counts are sparse postings (language, source, term).  A pair of sources differs
   by a sum over all kept terms; terms that one or both lack have the same
   smoothed share everywhere, so such a sum is (a) all terms as if absent from both,
   (b) for each source the change by its own terms, from the histogram of its
   shares, (c) a correction for terms that both have.  Sources meet in blocks.

Shares are whole numbers of a billionth, all arithmetic is exact.  Edges: null
text, lang and source count as empty strings; a row is a document, also where ids
or rows repeat; a group without terms counts; a language without kept terms has
pairs of value 0 and no terms; one with one source has no pairs; an empty table
gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release

#: Bytes of text that a task holds before it closes its blocks.
BLOCK = 32 << 20
#: Sources in a block of sources.
SIDE = 128
UNIT = 1_000_000_000
#: Each byte: A-Z in lower case, other ASCII than letters a space, the rest as it is.
PLAIN = bytes(x + 32 if 65 <= x <= 90 else 32 if x < 65 or 91 <= x <= 96 or 123 <= x <= 127 else x for x in range(256))
TOLD = pa.schema([("block", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("text", pa.binary())])


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts (a source of a block, compressed) and rows of terms."""
    from pyspark import TaskContext

    part, number, size = TaskContext.get().partitionId(), 0, 0
    held: dict = defaultdict(lambda: defaultdict(list))

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in TOLD], schema=TOLD)

    def closed() -> Iterator[pa.RecordBatch]:
        for at, (lang, sources) in enumerate(held.items()):
            block, df = f"{part}-{number}-{at}", Counter()
            for source, texts in sources.items():
                for text in texts:
                    df.update(set(text.split()))
                blob = zstandard.ZstdCompressor(level=1).compress(b" " + b" ".join(texts) + b" ")
                yield rows(1, block=pa.array([block]), lang=pa.array([lang]), source=pa.array([source]), text=pa.array([blob], pa.binary()))
            terms, n = [*df], [*df.values()]
            for k in range(0, len(terms), 50_000):
                some = pa.array(terms[k : k + 50_000], pa.binary()).cast(pa.string())
                yield rows(len(some), block=pa.repeat(block, len(some)), lang=pa.repeat(lang, len(some)), term=some, df=pa.array(n[k : k + 50_000], pa.int64()))

    for batch in batches:
        texts, langs, sources = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for text, lang, source in zip(texts, langs, sources, strict=True):
            held[lang][source].append(text.translate(PLAIN))
            size += len(text) + 64
            if size >= BLOCK:
                yield from closed()
                held.clear()
                number, size = number + 1, 0
    yield from closed()
    held.clear()
    release()


def _recount(texts: pa.Table, terms: pa.Table) -> pa.Table:
    """Occurrences of a block's kept terms in each of its sources."""
    import ahocorasick

    names = terms.column("term").to_pylist()
    out: list[tuple[str, str, np.ndarray, np.ndarray]] = []
    if names and texts.num_rows:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, name in enumerate(names):
            automaton.add_word(f" {name} ", k)
        automaton.make_automaton()
        for lang, source, blob in zip(*(texts.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            # neighbours share their delimiter: the automaton reports overlapping matches too
            n = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(zstandard.ZstdDecompressor().decompress(blob).decode())), np.int32))
            seen = np.flatnonzero(n)
            out.append((lang, source, seen, n[seen]))
    found = np.concatenate([x[2] for x in out]) if out else np.zeros(0, np.int64)
    times = pa.array(np.repeat(np.arange(len(out)), np.array([len(x[2]) for x in out], np.int64)))
    table = pa.table(
        {
            "lang": pa.array([x[0] for x in out], pa.string()).take(times),
            "source": pa.array([x[1] for x in out], pa.string()).take(times),
            "term": terms.column("term").combine_chunks().cast(pa.string()).take(pa.array(found)),
            "n": pa.array(np.concatenate([x[3] for x in out]) if out else found, pa.int64()),
        }
    )
    release()
    return table


def postings(documents: DataFrame, min_documents: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, source) of the groups, (lang, term) kept, and (lang, source, term, n) with n > 0."""
    texts = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    told = cut(texts.mapInArrow(_first_pass, "block string, lang string, source string, term string, df long, text binary"))
    blobs = told.where(F.col("text").isNotNull()).select("block", "lang", "source", "text")
    own = told.where(F.col("term").isNotNull()).select("block", "lang", "term", "df")
    # a hash first: sorts compare rows by the beginning of the first column, and languages are few
    term = Window.partitionBy(F.xxhash64("term", "lang"), "term", "lang")
    # a term has a row a block: its sum and one row of its own (``one``) need a single exchange
    frequent = own.withColumn("all_df", F.sum("df").over(term)).withColumn("one", F.row_number().over(term.orderBy("block")) == 1)
    known = cut(frequent.where(F.col("all_df") >= min_documents).select(F.col("block").alias("home"), "lang", "term", "one"))
    kept = known.where("one").select("lang", "term")
    counted = blobs.groupBy("block").cogroup(known.select("home", "term").groupBy("home")).applyInArrow(_recount, "lang string, source string, term string, n long")
    return blobs.select("lang", "source").distinct(), kept, cut(counted.groupBy("term", "lang", "source").agg(F.sum("n").alias("n")).select("lang", "source", "term", "n"))


def _share(n: Column, all_n: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (all_n + 2 * terms)), in whole numbers."""
    wide = "decimal(20,0)"
    over = (n.cast(wide) + 2) * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", over, all_n.cast(wide) + terms.cast(wide) * 2) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _emit(cells: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The sums of pairs of different sources, from matrices keyed by language and blocks of sources."""
    for (lang, a, b), value in cells.items():
        s, t = np.nonzero(value)
        found, s, t = value[s, t], s + a * SIDE, t + b * SIDE
        keep = s != t
        columns = [pa.array([lang] * int(keep.sum()), pa.string()), *(pa.array(x[keep], pa.int64()) for x in (s, t, found))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "s", "t", "value"])


#: Matrices that a task holds before it writes its sums.
MATRICES = 256


def _entries(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, source, share and share of absence of all entries of a column of lists."""
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return row, *(flat.field(c).to_numpy() for c in ("s", "p", "q0"))


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c): for sources that both have a term, what replaces the shares of absence."""
    cells: dict[tuple, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        code, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
        (rx, sx, px, qx), (ry, sy, py, qy) = (_entries(batch.column(c)) for c in (1, 2))
        # a list holds sources of one block of them
        heads = [s[np.searchsorted(r, np.arange(batch.num_rows))] // SIDE for r, s in ((rx, sx), (ry, sy))]
        where, which = np.unique(np.stack([code, *heads]), axis=1, return_inverse=True)
        for k, (lang, a, b) in enumerate(where.T.tolist()):
            key, mine = (names[lang], a, b), np.flatnonzero(which.reshape(-1) == k)
            place = np.zeros(batch.num_rows, np.int64)
            place[mine] = np.arange(len(mine))
            at = np.isin(ry, mine)
            # shares of a source that lacks the term are those of absence, and add nothing
            absent = np.ones(SIDE, np.int64)
            absent[sy[at] % SIDE] = qy[at]
            shares = np.tile(absent, (len(mine), 1))
            shares[place[ry[at]], sy[at] % SIDE] = py[at]
            used = np.unique(sy[at] % SIDE)
            shares, absent = shares[:, used], absent[used]
            if key not in cells:
                if len(cells) >= MATRICES:
                    yield from _emit(cells)
                    cells = {}
                cells[key] = np.zeros((SIDE, SIDE), np.int64)
            in_x = np.isin(rx, mine)
            for s in np.unique(sx[in_x]):
                own = in_x & (sx == s)
                p, q, other = px[own][:, None], qx[own][:1], shares[place[rx[own]]]
                cells[key][s % SIDE, used] += (_f(p, other) - _f(p, absent) - _f(q, other)).sum(axis=0) + _f(q, absent) * len(other)
    yield from _emit(cells)


def _own_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b): for a source and others, the change by the terms that the first has."""
    for batch in batches:
        for lang, s, q0, shares, others in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            p, n = np.array([(e["p"], e["n"]) for e in shares], np.int64).T[:, :, None]
            t, q = np.array([(e["s"], e["q0"]) for e in others], np.int64).T
            value = ((_f(p, q) - _f(np.int64(q0), q)) * n).sum(axis=0)
            keep = t != s
            size = int(keep.sum())
            columns = [pa.array([lang] * size, pa.string()), pa.array([s] * size, pa.int64()), pa.array(t[keep]), pa.array(value[keep])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "s", "t", "value"])


def divergence(documents: DataFrame, min_documents: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): each other source of the language
    by how far its shares lie (``pair``), and the ``top`` terms that a source uses
    more than its language does (``term``)."""
    found, kept, counts = postings(documents, min_documents)
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("all_n"))
    groups = found.join(totals, ["lang", "source"], "left").join(size, "lang", "left").withColumn("s", number).na.fill(0, ["all_n", "v"])
    groups = cut(groups.withColumn("q0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("all_n"), F.col("v")))))
    shares = cut(counts.join(groups, ["lang", "source"]).select("lang", "term", "source", "s", "q0", "n", _share(F.col("n"), F.col("all_n"), F.col("v")).alias("p")))

    entry = F.collect_list(F.struct("s", "p", "q0"))
    block = F.expr(f"s div {SIDE}")
    sides = shares.groupBy("term", "lang", block.alias("side")).agg(entry.alias("x"))
    met = sides.join(sides.select("lang", "term", F.col("side").alias("other"), F.col("x").alias("y")), ["term", "lang"]).select("lang", "x", "y")
    cells = "lang string, s long, t long, value long"
    both = met.mapInArrow(_shared_terms, cells)

    histogram = shares.groupBy("lang", "s", "q0", "p").agg(F.count("*").alias("n")).groupBy("lang", "s", "q0").agg(F.collect_list(F.struct("p", "n")).alias("shares"))
    others = groups.groupBy("lang", block.alias("side")).agg(F.collect_list(F.struct("s", "q0")).alias("others"))
    own = histogram.join(others, "lang").select("lang", "s", "q0", "shares", "others").mapInArrow(_own_terms, cells)
    turned = own.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), "value")

    first, second = groups.select("lang", "s", "q0", "v"), groups.select("lang", F.col("s").alias("t"), F.col("q0").alias("q1"))
    absent = first.join(second, "lang").where(F.col("s") != F.col("t")).select("lang", "s", "t", F.coalesce(F.col("v") * _gap(F.col("q0"), F.col("q1")), F.lit(0)).cast("long").alias("value"))
    pairs = absent.unionByName(both).unionByName(own).unionByName(turned).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "s", "source")
    named = pairs.join(names, ["lang", "s"]).join(names.select("lang", F.col("s").alias("t"), F.col("source").alias("item")), ["lang", "t"])
    pair = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    whole = counts.groupBy("term", "lang").agg(F.sum("n").alias("n"))
    all_n = whole.groupBy("lang").agg(F.sum("n").alias("all_n"))
    general = whole.join(all_n.join(size, "lang"), "lang").select("lang", "term", _share(F.col("n"), F.col("all_n"), F.col("v")).alias("q"))
    above = shares.join(general, ["term", "lang"]).where(F.col("p") > F.col("q"))
    term = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top))
