import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import ann, byte_bpe, chat, jaccard_join, licenses, line_rules, mixing, ngram_lm, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, block string"
WORDS = [f"w{i}" for i in range(400)]
SF = "/root/testdata/sf0.001"


def docs_of(spark, texts, sources=None):
    """Documents with nulls and with names that operators use themselves."""
    rows = [(i, t, None, (sources or {}).get(i), None, None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def random_texts(n, seed, length=(5, 60)):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(*length))) for _ in range(n)]


EDGE = [None, "", "  \n\t ", "one", "one two", "x" * 5000, "a b c d e\n" * 3]


def components(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed):
    rng = np.random.default_rng(seed)
    base = [list(rng.choice(WORDS, 120)) for _ in range(4)]
    passage = list(rng.choice(WORDS, 30))
    out = []
    for k in range(60):
        w = list(base[k % 4])
        for at in rng.choice(len(w), rng.integers(0, 5), replace=False):
            w[at] = f"n{rng.integers(10**6)}"
        out.append(" ".join(w + (passage if k % 3 == 0 else [])))
    return out + [" ".join(passage), out[0], out[0].upper()]


@pytest.mark.parametrize("n,percent,seed", [(4, 85, 1), (5, 80, 2), (1, 50, 3)])
def test_jaccard_is_exact(spark, n, percent, seed):
    texts = EDGE + near_copies(seed) + random_texts(20, seed)
    got = jaccard_join.jaccard_components(docs_of(spark, texts), n, percent).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == components(texts, n, percent)


def test_jaccard_meets_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MEETING", 2)
    texts = near_copies(7)
    got = jaccard_join.jaccard_components(docs_of(spark, texts), 4, 85).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == components(texts, 4, 85)


def test_jaccard_repeated_rows_nulls_and_empty(spark):
    d = docs_of(spark, ["a b c d e", "a b c d e", "z"])
    again = d.unionByName(d).unionByName(d.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = Counter(tuple(r)[:3] for r in jaccard_join.jaccard_components(again).collect())
    got_size = 1  # the null id's text is one of these, of one n-gram
    assert got == {(0, 1, 0): 2, (1, 1, 0): 2, (2, 1, 2): 2, (None, got_size, None): 1}
    assert jaccard_join.jaccard_components(d.limit(0)).count() == 0


def test_fragments_are_ranges_that_keep_whole_hashes():
    g = np.concatenate([np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64, endpoint=False), np.array([0, 2**64 - 1], np.uint64)])
    for fragments in (256, 257, 1000, 4097):
        own = jaccard_join._fragment(g, fragments)
        least = np.array([jaccard_join._least_gram(int(f), fragments) for f in own], np.uint64)
        assert own.min() >= 0 and own.max() < fragments and (np.diff(own[np.argsort(g)]) >= 0).all()
        assert np.array_equal(jaccard_join.unpack7(jaccard_join.pack7(g - least)) + least, g)


def test_jaccard_where_ids_repeat_with_other_texts(spark):
    z = " ".join(f"z{k}" for k in range(40))
    rows = [(1, "a b c"), (1, z), (5, z), (7, z + " more")]
    rng = np.random.default_rng(4)
    rows += [(int(rng.integers(20, 45)), t) for t in near_copies(11) + EDGE]
    got = jaccard_join.jaccard_components(spark.createDataFrame([(*r, None, None, None, None, None, None) for r in rows], DOCS), 4, 85, count_links=False).collect()
    # brute force by rows: the smallest doc_id of a row's component
    plain = components([t for _, t in rows], 4, 85)
    least = {}
    for (doc_id, _), (_, n, c) in zip(rows, plain, strict=True):
        least[c] = min(least.get(c, doc_id), doc_id)
    want = sorted((doc_id, n, least[c]) for (doc_id, _), (_, n, c) in zip(rows, plain, strict=True))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert {(5, 37, 1), (7, 38, 1), (1, 1, 1)} <= set(want)


def test_jaccard_of_a_hot_class(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", 3)
    texts = ["a b c d e f"] * 30 + random_texts(6, 12) + ["a b c d e f"]
    got = jaccard_join.jaccard_components(docs_of(spark, texts), 4, 85).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == components(texts, 4, 85) and {r.n_links for r in got} == {0}


@pytest.mark.parametrize("narrow,grams", [(128, 1 << 19), (8, 1 << 19), (8, 400)])
def test_jaccard_counts_every_link(spark, monkeypatch, narrow, grams):
    monkeypatch.setattr(jaccard_join, "NARROW", narrow)
    monkeypatch.setattr(jaccard_join, "BLOCK_GRAMS", grams)
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    texts = EDGE + near_copies(6)
    texts += [t.upper() for t in texts[10:14]] + [t.replace(" ", "  ") for t in texts[10:40]] + texts[20:23] + random_texts(10, 6)
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    one = {(t or ""): i for i, t in reversed(list(enumerate(texts)))}
    want = [sum(j != one[t or ""] and bool(a) and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]) for j in one.values()) for t, a in zip(texts, sets, strict=True)]
    got = jaccard_join.jaccard_components(docs_of(spark, texts), 4, 85).orderBy("doc_id").collect()
    assert max(want) > 10 and [r.n_links for r in got] == want


def test_line_rules_against_plain_counts(spark):
    texts = EDGE + random_texts(10, 4, (40, 90)) + ["é #*# <b> $5 100% a&b | x", "w " * 40_000, "é" * 300_000] + ["the cat sat the cat sat on\nhome | menu\nhome | menu\n$$$ ### a"]
    got = {r.doc_id: r for r in line_rules.clean_lines(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k for j, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        assert got[i].n_symbols == sum(c in "#*$%&|<>" for c in t or "") and got[i].base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (got[i].kept and got[i].base_failed)
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
    last = got[len(texts) - 1]
    assert last.cleaned == "the cat sat the cat sat on" and not last.kept
    assert got[len(EDGE)].kept == (got[len(EDGE)].n_words >= 50)


def test_licenses(spark):
    texts = [None, "", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "licensed under the Apache License, 2.0", "All Rights Reserved; all rights reserved", "general public licence", "Copyright (c) 2020 Jo Doe. All rights reserved."]
    got = [r for r in licenses.scan_licenses(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert [r.labels for r in got] == ["", "", "cc-by,cc-by-nc", "mit", "apache-2.0", "reserved", "", "copyright,reserved"]
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[0].first_word) == (2, 0, 3, None)
    auto = licenses.Automaton.compile("a <<optional>>b<</optional>> c <<any:2>> d")
    accepts = {s: auto.longest(s.encode().split(), 0) for s in ("a c d", "a b c x d", "a c x y d", "a c x y z d", "a b d")}
    assert accepts == {"a c d": 3, "a b c x d": 5, "a c x y d": 5, "a c x y z d": 0, "a b d": 0}


def test_license_markup_nests_and_matches():
    auto = licenses.Automaton.compile("a <<optional>>b <<optional>>c<</optional>> d<</optional>> <<match:[0-9]+>> e")
    runs = {s: auto.longest(s.encode().split(), 0) for s in ("a 1 e", "a b d 12 e", "a b c d 1 e", "a c 1 e", "a b 1 e", "a x e", "a 1 e e")}
    assert runs == {"a 1 e": 3, "a b d 12 e": 5, "a b c d 1 e": 6, "a c 1 e": 0, "a b 1 e": 0, "a x e": 0, "a 1 e e": 3}
    with pytest.raises(ValueError):
        licenses.Automaton.compile("a <<optional>>b")
    whole = licenses.LicenseScanner().scan(b"Foo is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.")
    assert "gpl-header" in whole["labels"].split(",") and whole["base_labels"] == "gpl" and whole["score"] > 0.9


def as_regex(template):
    """A template as a regular expression over words that each end in a blank."""
    import re

    out = ""
    for part in re.findall(r"<<.*?>>|[^<]+", template):
        if part in ("<<optional>>", "<</optional>>"):
            out += "(?:" if part[2] == "o" else ")?"
        elif part.startswith("<<any:"):
            out += r"(?:[^ ]+ ){0,%s}" % part[6:-2]
        elif part.startswith("<<match:"):
            out += "(?:%s) " % part[8:-2]
        else:
            out += "".join(re.escape(w.decode()) + " " for w in licenses.words_of(part.encode()))
    return re.compile("(?: )(?=(%s))" % out)


def test_licenses_against_regular_expressions_and_plain_counts(spark):
    import re

    whole = [b" ".join(licenses.words_of(re.sub(r"<<any:\d+>>|<</?optional>>", " ", re.sub(r"<<match:([0-9a-z]*).*?>>", lambda m: m[1] or "3", t)).encode())).decode() for t in licenses.TEMPLATES.values()]
    texts = EDGE + whole + [w.upper().replace(" ", ", ", 3) for w in whole] + [" x ".join(whole)] + [w.rsplit(" ", 1)[0] for w in whole]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] if os.path.isdir(SF) else []
    patterns = {k: as_regex(t) for k, t in licenses.TEMPLATES.items()}
    d = docs_of(spark, texts)
    got = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    for i, t in enumerate(texts):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        places = [(k, v.decode() if isinstance(v, bytes) else v) for p, v in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        line = " " + "".join(w.decode() + " " for w in words)
        labels = {v for _, v in places} | {k for k, p in patterns.items() if any(m[1] for m in p.finditer(line))}
        r = got[i]
        assert (r.n_words, r.n_base, r.labels, r.base_labels) == (len(words), len(places), ",".join(sorted(labels)), ",".join(sorted({v for _, v in places})))
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None)) and 0 <= r.score < 1
    assert licenses.scan_licenses(d.limit(0)).count() == 0 and licenses.scan_licenses(d.unionByName(d)).count() == 2 * len(texts)


def test_mixing(spark):
    d = docs_of(spark, ["t"] * 3000, {i: "big" if i % 3 else None for i in range(3000)})
    out = mixing.mix_sources(d, {"big": 1.0, "": 1.0}, epochs=2.0)
    rates = {r.source: r.mix_rate for r in out.select("source", "mix_rate").distinct().collect()}
    assert abs(rates["big"] - 1.5) < 1e-9 and abs(rates[None] - 3.0) < 1e-9
    copies = Counter(out.groupBy("doc_id").count().select("count").toPandas()["count"])
    assert abs(sum(k * v for k, v in copies.items()) - 6000) < 350
    assert {tuple(r) for r in out.select("doc_id", "mix_copy").collect()} == {tuple(r) for r in mixing.mix_sources(d.repartition(7), {"big": 1.0, "": 1.0}, epochs=2.0).select("doc_id", "mix_copy").collect()}
    assert mixing.mix_sources(d.limit(0)).count() == 0
    u = [0.01, 0.3, 0.5, 0.9, 0.9999]
    got = spark.createDataFrame([(x,) for x in u], "u double").select(mixing.poisson_count(F.col("u"), F.lit(1.3)).alias("k")).collect()
    want = []
    for x in u:
        k, p = 0, math.exp(-1.3)
        f = p
        while f < x:
            k += 1
            p *= 1.3 / k
            f += p
        want.append(k)
    assert [r.k for r in got] == want


def test_poisson_of_a_large_mean(spark):
    u = [0.001, 0.2, 0.5, 0.8, 0.999]
    got = spark.createDataFrame([(x,) for x in u], "u double").select(mixing.poisson_count(F.col("u"), F.lit(1000.0)).alias("k")).collect()
    terms = np.cumsum([math.exp(k * math.log(1000) - 1000 - math.lgamma(k + 1)) for k in range(1500)])
    assert [r.k for r in got] == [int(np.searchsorted(terms, x)) for x in u]


def test_chat(spark):
    call = '{"tool_calls":[{"id":"c1","name":"add","arguments":{"b":2,"a":1}},{"id":"c2","name":"add","arguments":{"a":"x"}},{"id":"c3","name":"nope","arguments":"{"}]}'
    rows = [(1, 0, "user", "hi"), (1, 1, "tool", '{"tool_call_id":"c1","content":"3"}'), (1, 2, "assistant", call), (1, 3, "tool", '{"tool_call_id":"zz","content":"?"}'), (2, 0, None, None), (2, 1, "user", "{bad")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.turn): r for r in chat.format_chats(chat.parse_messages(m), {"add": {"a": ("integer", True), "b": ("integer", False)}}).collect()}
    asked = out[1, 2]
    assert (asked.n_calls, asked.n_answered, asked.n_invalid) == (3, 1, 2)
    assert '"arguments":{"a":1,"b":2},"id":"c1","name":"add","valid":true' in asked.json
    assert out[1, 1].level == 3 and not out[1, 1].cyclic and out[1, 3].orphan
    assert out[2, 1].json == '{"calls":[],"content":"{bad","result_of":"","role":"user"}' and out[2, 0].json == '{"calls":[],"content":"","result_of":"","role":""}'
    assert chat.format_chats(chat.parse_messages(m.limit(0)), {}).count() == 0


def call_of(i):
    return '{"tool_calls":[{"id":"%s","name":"f","arguments":{}}],"content":""}' % i


def test_chat_orders_long_chains_and_finds_cycles(spark):
    # conversation 1: message t is the result of the call of t + 1 and makes call t itself
    both = lambda own, of: '  {"tool_calls":[{"id":"%s","name":"f","arguments":{}}],"tool_call_id":"%s","content":""}' % (own, of)
    rows = [(1, t, "tool", both(t, t + 1)) for t in range(100)] + [(1, 100, "assistant", call_of(100))]
    # 2: a cycle of three with a tail, and a message apart; 3: its own call; 4: nothing late
    rows += [(2, 0, "a", both("a", "b")), (2, 1, "a", both("b", "c")), (2, 2, "a", both("c", "a")), (2, 3, "a", both("d", "c")), (2, 4, "a", both("e", "d")), (2, 5, "u", "x")]
    rows += [(3, 0, "a", both("z", "z")), (4, 0, "a", call_of("q")), (4, 1, "t", '{"tool_call_id":"q","content":"r"}'), (4, 1, "t", "same turn")]
    m = spark.createDataFrame(rows * 2 + [(None, None, None, None)], "conv_id long, turn long, role string, text string").withColumns({"level": F.lit(1), "id": F.lit("x"), "calls": F.lit(2)})
    got = chat.format_chats(chat.parse_messages(m), {}).collect()
    assert len(got) == 2 * len(rows) + 1
    level = {(r.conv_id, r.turn): (r.level, r.cyclic) for r in got}
    assert [level[1, t] for t in range(101)] == [(200 - t, False) for t in range(101)]
    assert [level[2, t] for t in range(6)] == [(0, True), (1, True), (2, True), (3, False), (4, False), (5, False)]
    assert level[3, 0] == (0, True) and level[4, 0] == (0, False) and level[4, 1] == (1, False)


def test_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 16))
    x[100:400] = x[7]  # a vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "score": F.lit("x"), "query_id": F.lit(None), "rank": F.lit(2), "members": F.lit(0)})
    v = v.unionByName(v.where("vec_id between 10 and 20"))  # repeated rows
    got = {}
    for r in ann.nearest(v, v.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    found = total = 0
    for q, own in got.items():
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(len(x)), -np.round(s, 9))) if i != q][:20]
        assert [a for a, _, _ in sorted(own)] == list(range(1, 21)) and all(abs(s[i] - b) < 1e-9 for _, i, b in own)
        found, total = found + len({i for _, i, _ in own} & set(want)), total + 20
    assert len(got) == 60 and found / total >= 0.9
    few = v.where("vec_id < 5").dropDuplicates(["vec_id"])
    assert ann.nearest(few, few.where("vec_id = 0"), 20).count() == 4 and ann.nearest(v.limit(0), v.limit(0)).count() == 0


def test_search_repeated_queries_and_large_k(spark):
    x = np.random.default_rng(6).normal(size=(400, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = v.where("vec_id = 3")
    got = [r.vec_id for r in ann.nearest(v, q.unionByName(q).unionByName(q), 20).collect()]
    assert len(got) == len(set(got)) == 20
    assert ann.nearest(v.coalesce(1), q, 399).count() == 399


def test_language_model(spark):
    """Against a plain backoff model that looks contexts up in counters."""
    texts = EDGE + random_texts(60, 8) + [" ".join(f"w{i % 7}" for i in range(k, k + 50)) for k in range(30)]
    texts += texts[10:40]
    got = {r.doc_id: r for r in ngram_lm.score_texts(docs_of(spark, texts), 7, 2).collect()}
    train, words = [], [(t or "").encode().lower().split() for t in texts]
    for i, w in enumerate(words):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.append(w)
    c = Counter(x for w in train for x in [*w, None])
    grams = Counter(g for w in train for n in (2, 3) for g in zip(*(["<s>", *w, None][k:] for k in range(n)), strict=False))
    n, kinds = sum(c.values()), len(c)
    context = Counter(c) + Counter({"<s>": len(train)})

    def p(v, x):
        if not v:
            return (c[x] + 1) / (n + kinds + 1)
        of, k = (context[v[0]], ngram_lm.STRENGTH[0]) if len(v) == 1 else (grams[v], ngram_lm.STRENGTH[1])
        if of < (1 if len(v) == 1 else ngram_lm.LEAST):
            return p(v[1:], x)
        return (grams[(*v, x)] + k * p(v[1:], x)) / (of + k)

    seen = 0
    for i, w in enumerate(words):
        base = score = 0.0
        whole = ["<s>", *w, None]
        for at in range(1, len(whole)):
            base += math.log10(p((), whole[at]))
            score += math.log10(p(tuple(whole[max(0, at - 2) : at]), whole[at]))
            seen += grams[tuple(whole[max(0, at - 2) : at + 1])] > 0
        r = got[i]
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n)
    assert seen > 1000
    total = sum(p(("w1", "w2"), x) for x in [*c, "unknown"])
    assert abs(total - 1) < 1e-9
    assert ngram_lm.score_texts(docs_of(spark, []), 7, 2).count() == 0
    d = docs_of(spark, ["a b", "a b"])
    twice = ngram_lm.score_texts(d.unionByName(d), 7, 2).collect()
    assert len(twice) == 4 and {r.train_tokens for r in twice} == {6 * sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in (0, 1))}


def test_classifiers(spark):
    good, bad = random_texts(150, 9, (40, 80)), [t.upper().replace(" ", "!! ") for t in random_texts(150, 10, (40, 80))]
    texts = [t for both in zip(good, bad, strict=True) for t in both] + EDGE
    d = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    voter = quality.fit_quality(d, labels, 3, 1)
    q = {r.doc_id: r.score for r in quality.score_quality(d, voter).collect()}
    assert len(q) == len(texts) and all((q[i] >= 0.5) == (i % 2 == 0) for i in range(300)) and all(0 <= s <= 1 for s in q.values())
    assert quality.keep(d, voter, 0.5).columns == d.columns
    insults = [f"{t} jerk{k}" if k % 2 else t for k, t in enumerate(random_texts(300, 11, (40, 80)))]
    e = docs_of(spark, insults + EDGE)
    machine = toxicity.fit_toxicity(e, labels, 4, 2)
    s = {r.doc_id: r.score for r in toxicity.score_toxicity(e, machine).collect()}
    assert sum((s[i] >= 0.3) == (i % 2 == 1) for i in range(300)) > 290
    kept = toxicity.keep(e, machine, 0.3)
    assert kept.columns == e.columns and abs(kept.where("doc_id < 300").count() - 150) <= 10
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert quality.score_quality(d, quality.fit_quality(d, none, 3, 1)).count() == len(texts)
        assert toxicity.score_toxicity(d, toxicity.fit_toxicity(d, none, 4, 2)).count() == len(texts)


def test_machine_learns_a_pair():
    """Two terms that mean nothing alone and label 1 together."""
    rng = np.random.default_rng(2)
    samples, labels = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        noise = rng.choice(np.arange(100, 50_000), 6, replace=False)
        samples.append(np.unique(np.concatenate([noise, [1] * int(a), [2] * int(b)]).astype(np.int64)))
        labels.append(float(a and b))
    m = toxicity.FactorizationMachine.fit(samples, np.array(labels))
    assert sum((m.score(s) >= 0.5) == bool(y) for s, y in zip(samples, labels, strict=True)) > 1450


def test_machine_learns_a_pair_of_terms_that_are_alike_in_both_classes():
    rng = np.random.default_rng(4)
    samples, labels = [], []
    for k in range(3000):
        a, b = rng.random(2) < 0.5
        noise = rng.choice(np.arange(100, 5000), 40, replace=False)
        samples.append(np.unique(np.concatenate([noise, [1] * int(a), [2] * int(b)]).astype(np.int64)))
        labels.append(float(a == b))
    m = toxicity.FactorizationMachine.fit(samples, np.array(labels))
    assert sum((m.score(s) >= 0.5) == bool(y) for s, y in zip(samples, labels, strict=True)) > 2900


def test_machine_keeps_a_rare_insult_beside_strong_ones():
    rng = np.random.default_rng(5)
    samples, labels = [], []
    for k in range(4000):
        strong, rare = k % 2 == 0 and k % 40 > 0, k % 40 == 0
        noise = rng.choice(np.arange(100, 5000), 40, replace=False)
        samples.append(np.unique(np.concatenate([noise, [1] * int(strong), [2] * int(rare)]).astype(np.int64)))
        labels.append(float(strong or rare))
    m = toxicity.FactorizationMachine.fit(samples, np.array(labels))
    assert m.index[2] >= 0 and m.score(np.array([2])) >= 0.5


@pytest.mark.parametrize("memo", [0, 50])
def test_byte_bpe_like_the_library(spark, memo):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = EDGE[:-1] + ["it's we'll  two spaces x\n\n y ", "Ünïcödé 汉字 🙂🙂 العربية", "aaaaaaaaaa !!!!!!! 1234567", "<|endoftext|> end"]
    bpe = byte_bpe.ByteBpe(ranks, P.PATTERN, memo_pieces=memo)
    out = bpe.decode(bpe.encode(docs_of(spark, texts))).orderBy("doc_id").collect()
    for r, t in zip(out, texts, strict=True):
        assert r.ids == library.encode_ordinary(t or "") and bytes(r.decoded) == (t or "").encode()


def test_folds_by_rounds_like_the_library(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    import random

    monkeypatch.setattr(byte_bpe, "LONG", 0)
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = random.Random(3)
    texts = ["".join(some.choices("abetnhi", k=some.randint(1, 80))) for _ in range(100)]
    texts += [w * k for w in ("a", "ab", "aba", "é", "汉字") for k in (1, 2, 3, 5, 16, 33, 70)] + ["".join(some.choices("abcdefghij", k=1500))]
    out = byte_bpe.ByteBpe(ranks, P.PATTERN, memo_pieces=1).encode(docs_of(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(out, texts, strict=True):
        assert r.ids == library.encode_ordinary(t)


def test_digests_like_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    import hashlib

    from terrafold.llm.queries import digests

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "one two two", "one two two", "Ünïcödé 汉字 🙂 zzqxv " * 50]
    got = digests(docs_of(spark, texts), byte_bpe.ByteBpe(ranks, P.PATTERN, memo_pieces=3)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ids = library.encode_ordinary(t or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_votes_against_plain_cosines():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 50, 12), return_counts=True) for _ in range(40)]
    rows += rows[:20] + [(np.zeros(0, np.int64), np.zeros(0))]  # ties among neighbours, and an empty text
    rows = [(t.astype(np.int64), c.astype(float)) for t, c in rows]
    voter = quality.LatentVoter.fit(rows, rng.integers(0, 2, len(rows)).astype(float))
    asked = [np.unique(rng.integers(0, 50, 9), return_counts=True) for _ in range(30)] + rows[-1:]
    latent = voter.latent([(t.astype(np.int64), c.astype(float)) for t, c in asked])
    got = voter.vote(latent)
    for cosines, score in zip(latent @ voter.vectors.T, got, strict=True):
        near = sorted(range(len(cosines)), key=lambda i: (-cosines[i], i))[: quality.NEIGHBOURS]
        weight = [max(0.0, float(cosines[i])) for i in near]
        want = sum(w * voter.labels[i] for w, i in zip(weight, near, strict=True)) / sum(weight) if sum(weight) else voter.labels.mean()
        assert abs(score - want) < 1e-6 and 0 <= score <= 1
    assert got[-1] == voter.labels.mean()


def test_machine_against_all_pairs():
    rng = np.random.default_rng(6)
    index = np.full(toxicity.TERMS, -1, np.int32)
    index[[5, 9, 77, 1000]] = np.arange(4)
    m = toxicity.FactorizationMachine(index, -0.3, rng.normal(size=4), rng.normal(size=(4, toxicity.RANK)))
    for own in ([], [5], [5, 9], [5, 9, 77, 1000], [3, 4]):
        rows = [int(index[t]) for t in own if index[t] >= 0]
        x = m.bias + sum(m.weights[i] for i in rows) + sum(float(m.vectors[i] @ m.vectors[j]) for i in rows for j in rows if i < j)
        assert abs(m.score(np.array(own, np.int64)) - 1 / (1 + math.exp(-x))) < 1e-9


def test_empty_and_repeated_rows(spark):
    d = docs_of(spark, [*random_texts(4, 1), "x " * 50_000, None, ""])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    P = pytest.importorskip("public_tokenizers")
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    models = quality.fit_quality(d, labels, 3, 1), toxicity.fit_toxicity(d, labels, 4, 2)
    runs = {
        "quality": lambda x: quality.score_quality(x, models[0]),
        "toxicity": lambda x: toxicity.score_toxicity(x, models[1]),
        "licenses": licenses.scan_licenses,
        "lines": line_rules.clean_lines,
        "bpe": lambda x: bpe.decode(bpe.encode(x)).select("doc_id", "ids", "decoded"),
        "lm": lambda x: ngram_lm.score_texts(x, 7, 2),
        "mix": lambda x: mixing.mix_sources(x),
    }
    for name, run in runs.items():
        assert run(d.limit(0)).count() == 0, name
        if name != "mix":
            rows = Counter(str(r) for r in run(d.unionByName(d)).collect())
            assert len(rows) == 7 and set(rows.values()) == {2}, name
    assert quality.score_quality(d, quality.fit_quality(d.limit(0), labels, 3, 1)).count() == 7


def test_mixing_keeps_columns_of_its_own_names(spark):
    d = docs_of(spark, random_texts(20, 2)).withColumns({"mix_source": F.lit("s"), "mix_key": F.lit(7), "mix_rate": F.lit("old"), "row": F.lit(1), "rate": F.lit(2), "key": F.lit(3)})
    out = mixing.mix_sources(d, epochs=3.0)
    assert set(out.columns) == set(d.columns) | set(mixing.RESULTS) and out.schema["mix_rate"].dataType.simpleString() == "double"
    assert {(r.mix_source, r.mix_key, r.row, r.rate, r.key) for r in out.collect()} == {("s", 7, 1, 2, 3)}


def test_mixing_by_a_salted_join(spark, monkeypatch):
    d = docs_of(spark, random_texts(200, 2), {i: f"s{i % 3}" for i in range(0, 200, 2)})
    want = Counter((r.doc_id, r.mix_copy) for r in mixing.mix_sources(d).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 1)
    assert Counter((r.doc_id, r.mix_copy) for r in mixing.mix_sources(d).collect()) == want


def test_one_of_each_group_where_ids_repeat(spark):
    from terrafold.llm.pipeline import one_of_each_group

    a, b, c = random_texts(3, 5, (40, 41))
    rows = [(1, a), (1, a), (1, b), (2, a), (3, b + " x"), (4, c), (None, a), (5, ""), (6, None)]
    d = spark.createDataFrame([(i, t, None, None, None, 1.0, 1, "x") for i, t in rows], DOCS)
    got = Counter((r.doc_id, r.text) for r in one_of_each_group(spark, d, "").collect())
    assert got[None, a] == got[4, c] == got[5, ""] == got[6, None] == 1 and sum(n for (_, t), n in got.items() if t == a) == 2
    assert sum(n for (_, t), n in got.items() if t in (b, b + " x")) == 1 and sum(got.values()) == 6
    assert one_of_each_group(spark, d.limit(0), "").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline_run_against_brute_force(spark):
    """Models are the stages' own; everything that they decide is done again row by row."""
    import hashlib

    from terrafold.llm.queries import digests

    import corpus_pipeline as C

    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    machine, cache = toxicity.fit_toxicity(docs, labels, 4, 2), toxicity.TermCache()
    rows = [r for r in docs.collect() if machine.score(toxicity.terms_of((r.text or "").encode(), cache)) < 0.3]
    docs = spark.createDataFrame(rows, docs.schema)
    assert C.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).columns == columns
    voter, words = quality.fit_quality(docs, labels, 3, 1), quality.WordCache()
    score = lambda t: voter.vote(voter.latent([quality.features((t or "").encode(), words)]))[0]
    rows = sorted((r for r in rows if score(r.text) >= 0.5), key=lambda r: r.doc_id)
    rows = [rows[i] for i, _, c in components([r.text for r in rows], 5, 80) if i == c]
    count = Counter(r.source for r in rows)
    target = {s: n**0.7 for s, n in count.items()}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter()
    for r in rows:
        rate = target[r.source] / sum(target.values()) * len(rows) / count[r.source]
        u = (int(hashlib.md5(f"{r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}:mix-1".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        k, p = 0, math.exp(-rate)
        f = p
        while f < u:
            k += 1
            p *= rate / k
            f += p
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += k
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.run(spark, SF).collect())
    assert len(got) > 50 and got == +want


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in entry.queries()
