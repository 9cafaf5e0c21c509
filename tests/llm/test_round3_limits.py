"""What a task or the driver holds, and what isn't worked out twice."""

import json
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa

from terrafold.llm import alignment, common, ngram_lm
from terrafold.llm.queries import ALIGNED_FILES


def test_lm_block_holds_few_bytes_a_token():
    words = np.random.default_rng(1).integers(0, 20_000, 400_000)
    table = pa.table({"doc_id": [1, 2], "held_out": [False, True], "text": [" ".join(f"w{x}" for x in half) for half in np.split(words, 2)]})
    tracemalloc.start()
    ngram_lm._ask_pairs(256)((pa.scalar(0),), table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * len(words), f"{peak / len(words):.0f} bytes a token"


def test_lm_numbers_as_unique_does():
    for keys in (np.zeros(0, np.int64), np.array([7], np.int64), np.random.default_rng(2).integers(-5, 5, 100)):
        distinct, number = ngram_lm._numbered(keys)
        want = np.unique(keys, return_inverse=True)
        assert distinct.tolist() == want[0].tolist() and number.tolist() == want[1].tolist()


ODD = ["", " ", "  ", "a", " a▁b", "▁", "<s>", " </s><unk>", "<0x41>", "\x00", "\x00\x01 ", "�", "﻿", " x", "é", "ﬁ", "ｆｕｌｌ", "<|endoftext|>", "\U0001f600‍", "\r\n\t", "　", "日本語", "ำ", "àͅ", "", "\U0010ffff"]


def test_alignment_tokenizes_only_doubtful_segments_of_blocks(monkeypatch):
    files = alignment.Tokenizers(*map(public_tokenizers.path, ALIGNED_FILES))
    segments = [f"{first}{x}{after}" for x in ODD for first in (" ", "  ", " w", ",") for after in ("", " ") if first + x + after != " "]
    want = alignment.tokenized(segments, files, keep=False)[0]
    asked, whole = [], alignment.tokenized
    monkeypatch.setattr(alignment, "tokenized", lambda s, *a, **k: asked.extend(s) or whole(s, *a, **k))
    assert alignment.sound(segments, files).tolist() == want.tolist() and not want.all()
    assert asked == [s for s in segments if "▁" in s]


def test_alignment_tokenizes_all_where_files_promise_nothing(tmp_path, monkeypatch):
    files = alignment.Tokenizers(*map(public_tokenizers.path, ALIGNED_FILES))
    other = json.loads(Path(files.a).read_text()) | {"normalizer": {"type": "NFC"}}
    (tmp_path / "a.json").write_text(json.dumps(other))
    changed = alignment.Tokenizers(str(tmp_path / "a.json"), files.b)
    assert not alignment._kept(changed)
    assert alignment.sound([" é", " e"], changed).tolist() == [False, True]


def test_written_tables_have_the_driver_trimmed(spark, monkeypatch):
    said, whole = [], common.trim
    monkeypatch.setattr(common, "trim", lambda s: said.append(whole(s)))
    assert common.cut(spark.range(3)).count() == 3
    assert len(said) == 1 and said[0].startswith("Trim native heap")
