"""Quality rules, line first: lines are judged, failing lines are removed, and a
document is rejected when its text loses too much, or by two whole-text rules.

Defined results: a null or empty text has no words and fails (fewer than 50
words); lines without a word are neither judged nor counted; a line equal to an
earlier one counts as a duplicate each time after the first; repeated rows and
further columns of the input don't matter; an empty table gives an empty table.
Texts are read whole, one at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import utf8

#: The symbols counted, and the words of navigation lines and of boilerplate.
SYMBOLS = b"#*$%&|<>"
NAVIGATION = frozenset(
    b"home menu login logout register search contact about next previous back top share print sitemap skip".split()
)
BOILERPLATE = re.compile(
    rb"cookie policy|accept cookies|privacy policy|terms of use|terms of service|enable javascript"
    rb"|all rights reserved|click here|subscribe to our|sign up for|lorem ipsum",
)
_NO_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_NO_CODE_POINT = bytes(range(0x80, 0xC0))  # continuation bytes of UTF-8

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_removed_lines long, removed_share double, cleaned string"
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the loss that a document survives."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_share: float = 0.1  # of a line's characters
    max_shouted_share: float = 0.5  # of its words end in two or more ! or ?
    max_bar_share: float = 0.3  # of its words are a lone | or bullet
    navigation_words: int = 8  # a line of at most so many words, all from the navigation list
    boilerplate_words: int = 25  # a boilerplate phrase condemns lines of at most so many words
    max_removed_share: float = 0.4  # of the word characters

    def line_fails(self, line: bytes, words: list[bytes]) -> bool:
        size = sum(map(len, words))
        if len(line.translate(None, _NO_SYMBOL)) > self.max_symbol_share * size:
            return True
        if sum(w[-2:] in (b"!!", b"??", b"?!", b"!?") for w in words) > self.max_shouted_share * len(words):
            return True
        if sum(w in (b"|", b"-", b"*", b"\xe2\x80\xa2") for w in words) > self.max_bar_share * len(words):
            return True
        low = line.lower()
        if len(words) <= self.navigation_words and all(w.strip(b".,:|>") in NAVIGATION for w in low.split()):
            return True
        return len(words) <= self.boilerplate_words and BOILERPLATE.search(low) is not None

    def judge(self, text: bytes) -> dict:
        words = text.split()
        chars = b"".join(words)
        word_chars = len(chars) - len(chars.translate(None, bytes(set(range(256)) - set(_NO_CODE_POINT))))
        seen: set[bytes] = set()
        kept_lines, n_dup, n_lines, lost = [], 0, 0, 0
        for line in text.split(b"\n"):
            if not (own := line.split()):
                kept_lines.append(line)
                continue
            n_lines += 1
            again = line in seen
            n_dup += again
            seen.add(line)
            if again or self.line_fails(line, own):
                lost += sum(map(len, own))
            else:
                kept_lines.append(line)
        repeat = repeated_words(words)
        failed = len(words) < self.min_words or 100 * repeat > self.max_repeat_percent * len(words)
        share = lost / len(chars) if chars else 0.0
        return {
            "n_words": len(words),
            "word_chars": word_chars,
            "n_symbols": len(text.translate(None, _NO_SYMBOL)),
            "n_dup_lines": n_dup,
            "n_repeat_words": repeat,
            "base_failed": failed,
            "kept": not failed and share <= self.max_removed_share,
            "n_lines": n_lines,
            "n_removed_lines": n_lines - sum(bool(x.split()) for x in kept_lines),
            "removed_share": share,
            "cleaned": b"\n".join(kept_lines).decode("utf-8", "replace"),
        }


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total, end = 0, 0  # words before `end` are counted
    for i, window in enumerate(windows):
        if window in often:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def clean_lines(documents: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """A row for each document: the counts, the verdict and the cleaned text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [rules.judge(t) | {"doc_id": d} for d, t in zip(part.column(0).to_pylist(), utf8(part), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [(n, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))]
)
