"""Line dedup, tokenizer alignment and source divergence against plain counts."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from terrafold.llm import alignment, divergence, line_dedup
from terrafold.llm.queries import ALIGNED_FILES, op12_tokenizer_alignment

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, pos int, block string, term string"
FILES = alignment.Tokenizers(*map(public_tokenizers.path, ALIGNED_FILES))
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    """(doc_id, text, lang, source) with further columns of names that the operators use."""
    return spark.createDataFrame([(*(*r, None, None)[:4], None, 1, 2, "b", "t") for r in rows], DOCS)


# --- line dedup -------------------------------------------------------------


def plain_dedup(rows, min_chars, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and doc_id != max(held[key(x)], key=lambda d: (d is not None, d or 0)) for x in lines]
        out.append((doc_id, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def spark_dedup(spark, rows, min_chars=40, min_docs=5):
    got = line_dedup.dedup_lines(docs_of(spark, rows), min_chars, min_docs)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()), key=repr)


LONG = ["The quick brown fox jumps over the lazy dog %d times" % k for k in range(12)]


def lines_corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lines = [LONG[k] if rng.random() < 0.7 else LONG[k].upper() + " \t" for k in rng.integers(0, 12, rng.integers(0, 9))]
        out.append((int(rng.integers(0, n)), "\n".join([*lines, "short", ""][: rng.integers(0, 11)])))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_dedup_plain(spark, seed):
    rows = lines_corpus(seed) + [(None, LONG[0]), (None, LONG[1]), (7, None), (8, ""), (9, "\n\n"), (10, "é" * 40), (10, "é" * 40)]
    assert spark_dedup(spark, rows) == plain_dedup(rows, 40, 5)


def test_dedup_sliced(spark, monkeypatch):
    """Hashes with many rows go through slices and merged sums."""
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 3)
    rows = lines_corpus(5) + [(100 + i, LONG[0] + "\n" + LONG[0]) for i in range(40)]
    assert spark_dedup(spark, rows) == plain_dedup(rows, 40, 5)


def test_dedup_bounds(spark):
    rows = [(i, "x" * 39 + "\n" + "y" * 40 + "\n" + " " + "é" * 40 + "\r\nend") for i in range(5)] + [(i, "z" * 50) for i in range(10, 14)]
    got = spark_dedup(spark, rows)
    assert got == plain_dedup(rows, 40, 5)
    assert {(r[0], r[2]) for r in got} == {(0, 2), (1, 2), (2, 2), (3, 2), (4, 0), (10, 0), (11, 0), (12, 0), (13, 0)}


def test_dedup_long_text_and_bitmap(spark):
    """Many words of a bitmap, first and last lines of a word among them."""
    shared = [f"line number {k} that five documents hold in common" for k in (0, 63, 64, 127, 128, 1000, 4999)]
    base = [f"{i} own line of the text, long enough to have a key of its own" for i in range(5000)]
    for k, s in zip((0, 63, 64, 127, 128, 1000, 4999), shared, strict=True):
        base[k] = s
    rows = [(i, "\n".join(base) if i == 0 else "\n".join(shared)) for i in range(5)]
    got = spark_dedup(spark, rows)
    assert got == plain_dedup(rows, 40, 5)
    bitmap = line_dedup.drop_bitmaps(docs_of(spark, rows)).where("doc_id = 0").first().dropped
    assert [w.word for w in bitmap] == [0, 1, 2, 15, 78] and sum(bin(w.bits & (2**64 - 1)).count("1") for w in bitmap) == 7


def test_dedup_empty(spark):
    assert line_dedup.dedup_lines(docs_of(spark, [])).collect() == []


def test_dedup_native(spark):
    plan = line_dedup.dedup_lines(docs_of(spark, lines_corpus(1)))._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan.lower() or "RepartitionByExpression" in plan
    assert not re.search("Python|Arrow|Pandas", plan)


# --- tokenizer alignment ----------------------------------------------------


def plain_alignment(rows):
    """Whole texts through both tokenizers, without segments."""
    a, a_bytes, b, b_bytes = alignment._loaded(FILES)
    made, count = [], Counter()
    for doc_id, text in rows:
        whole = b" " + (text or "").encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        if not text or b"".join(a_bytes[i] for i in ids_a) != whole or b"".join(b_bytes[i] for i in ids_b) != whole:
            made.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(a_bytes[i]) for i in ids_a]), np.cumsum([len(b_bytes[i]) for i in ids_b])
        links = [(i, j) for i, e in zip(ids_a, ends_a, strict=True) for j in np.array(ids_b)[ends_b == e].tolist()] if len(ids_a) < 3000 else None
        if links is None:
            at = dict(zip(ends_b.tolist(), ids_b, strict=True))
            links = [(i, at[e]) for i, e in zip(ids_a, ends_a.tolist(), strict=True) if e in at]
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups, i, j = [], 0, 0
        for c in cuts:
            i2, j2 = int(np.searchsorted(ends_a, c, "right")), int(np.searchsorted(ends_b, c, "right"))
            groups.append(",".join(map(str, ids_a[i:i2])) + "|" + ",".join(map(str, ids_b[j:j2])))
            i, j = i2, j2
        made.append((doc_id, ids_a, ids_b, groups, links))
        count.update(links)
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for doc_id, ids_a, ids_b, groups, links in made:
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), ";".join(groups)))
    return sorted(out, key=repr), count


ODD = [
    None, "", " ", "  ", "a", " a", "  a  b ", "a\tb\nc \n d", "a \nb", "a b c", "x　 y", "<s> and </s> <unk> <0x0A>", "<|endoftext|> end <|endoftext|>",
    "with ▁ inside", "▁", "it's we'll I'd 12 3456", "é é ñandú", "日本語 テキスト 😀 👩‍👩‍👧", "tab\t tab", "\x00 nul \x1f x", "a  b   c    d", "end ", "\r\n\r\n x",
    "word" * 3000, "x " * 2000, "…—“q”", "  line", "\x85 next", "ｆｕｌｌ ﬁ", "a​ b",
]


def spark_alignment(spark, rows):
    got = alignment.align(docs_of(spark, rows), FILES).collect()
    return sorted(((r.doc_id, *(r[c] for c in alignment.SUMS), r.groups) for r in got), key=repr)


def test_alignment_plain(spark):
    rng = np.random.default_rng(3)
    signs = [*"abcdeABC  \n\t'.,;1290é日▁ "]
    rows = list(enumerate(ODD)) + [(1000 + i, "".join(rng.choice(signs, rng.integers(1, 80)))) for i in range(150)] + [(3, "ties and rows"), (3, "ties and rows"), (None, "no id")]
    want, count = plain_alignment(rows)
    assert spark_alignment(spark, rows) == want
    assert {(r.a, r.b): r.n for r in alignment.id_links(docs_of(spark, rows), FILES).collect()} == dict(count)


def test_alignment_blocks(spark, monkeypatch):
    """Segments of many blocks meet again."""
    monkeypatch.setattr(alignment, "BLOCK", 500)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 10)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = list(enumerate(texts))
    assert spark_alignment(spark, rows) == plain_alignment(rows)[0]


def test_alignment_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(*w[:-1], sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in plain_alignment(rows)[0]]
    got = op12_tokenizer_alignment(spark, SF)
    assert sorted(((r.doc_id, *(r[c] for c in alignment.SUMS), r.groups_sha256) for r in got.collect()), key=repr) == want


def test_alignment_zero_lengths(spark):
    """Tokens without bytes end together with the one before them and stay in its group."""
    segments = spark.createDataFrame([(1, 2, [], [1, 2, 3], [2, 0, 1], [7, 8], [2, 1])], f"id long, n long, homes array<struct<home:long,k:int>>, {alignment.TOKENS}")
    figures, pairs, _ = alignment.aligned_segments(segments)
    r = figures.first()
    assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == (3, 2, 2, 3, "1,2|7;3|8")
    assert {(p.a, p.b, p.n) for p in pairs.collect()} == {(1, 7, 2), (2, 7, 2), (3, 8, 2)}


def test_alignment_empty(spark):
    assert alignment.align(docs_of(spark, []), FILES).collect() == []
    assert spark_alignment(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


# --- source divergence ------------------------------------------------------


def plain_divergence(rows, min_docs, top):
    rows = [(t or "", g or "", s or "") for _, t, g, s in rows]
    words = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOW)), g, s) for t, g, s in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for w, g, s in words:
        df[g].update(set(w))
        count[g, s].update(w)
    out = []
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for g in {x[1] for x in rows}:
        kept = [t for t, n in df[g].items() if n >= min_docs]
        sources = sorted({s for _, h, s in rows if h == g})
        n = {s: sum(count[g, s][t] for t in kept) for s in sources}
        p = {s: {t: share(count[g, s][t], n[s], len(kept)) for t in kept} for s in sources}
        q = {t: share(sum(count[g, s][t] for s in sources), sum(n.values()), len(kept)) for t in kept}
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if count[g, s][t] and p[s][t] > q[t]]
            for part, own, k in (("pair", pair, len(pair)), ("term", term, top)):
                ordered = sorted(own, key=lambda x: (-x[0], x[1].encode()))[:k]
                out += [(g, s, part, item, value, rank) for rank, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def spark_divergence(spark, rows, min_docs, top):
    got = divergence.divergence(docs_of(spark, rows), min_docs, top).collect()
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got)


def sources_corpus(seed, n=120, sources=9):
    rng = np.random.default_rng(seed)
    vocabulary = [*"the of and Wort élan ÉLAN naïve x y z été 日本 alpha beta gamma delta don't".split()]
    rows = []
    for i in range(n):
        s = int(rng.integers(0, sources))
        own = rng.choice(vocabulary[: 5 + s], rng.integers(0, 12))
        rows.append((i % 50, "-1 ".join(own), [None, "en", "fr", "de"][int(rng.integers(0, 4))], f"src{s}" if s else None))
    return rows


@pytest.mark.parametrize(("seed", "side", "limits"), [(0, 128, [(3, 10), (1000, 10)]), (1, 2, [(1, 2)])])
def test_divergence_plain(spark, monkeypatch, seed, side, limits):
    monkeypatch.setattr(divergence, "SIDE", side)
    rows = sources_corpus(seed) + [(900, None, "en", "empty"), (901, "", "lonely", "one"), (902, "1 2 3", "none", "a"), (903, "1", "none", "b")]
    for min_docs, top in limits:
        assert spark_divergence(spark, rows, min_docs, top) == plain_divergence(rows, min_docs, top)


def test_divergence_blocks(spark, monkeypatch):
    """Counts and frequencies of many small blocks, repeated rows, a very long text."""
    monkeypatch.setattr(divergence, "BLOCK", 300)
    rows = sources_corpus(2) * 2 + [(5, "the of " * 5000, "en", "src1")]
    assert spark_divergence(spark, rows, 4, 10) == plain_divergence(rows, 4, 10)


def test_divergence_empty(spark):
    assert divergence.divergence(docs_of(spark, [])).collect() == []


def test_divergence_sorts_by_terms_first(spark, monkeypatch, capsys):
    """Languages are few, so sorts that begin with them compare whole strings; and a block without any kept term has no counts."""
    monkeypatch.setattr(divergence, "cut", lambda df: df)
    divergence.divergence(docs_of(spark, sources_corpus(3)), 2).explain()
    plan = capsys.readouterr().out
    assert "Sort [term#" in plan and not re.search(r"Sort \[lang#\d+L? ASC NULLS FIRST, term#", plan)
    kept = pa.table({"home": ["b"], "term": ["absent"]})
    blob = zstandard.ZstdCompressor().compress(b" other words ")
    for texts in ([("b", "en", "s", blob)], []):
        table = pa.table([pa.array([t[i] for t in texts], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.binary()))], names=["block", "lang", "source", "text"])
        assert divergence._recount(table, kept).num_rows == 0


def test_shares_of_large_counts(spark):
    """Counts whose product with a billionth leaves 64 bits."""
    n, all_n, v = 40_000_000_000, 90_000_000_000, 1000
    got = spark.createDataFrame([(n, all_n, v)], "n long, a long, v long").select(divergence._share(F.col("n"), F.col("a"), F.col("v")).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (all_n + 2 * v)
