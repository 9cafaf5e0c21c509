"""Alignment of two tokenizers over the same texts.

Tokenizer A is byte-level BPE (it reads a space and the text), B is a piece model
(it adds that space itself).  Both start a new token at a space that follows
another character than a space and stands before one that isn't white space, and
at one of ``,.;:!?`` behind a Latin letter; a text is cut there, and equal
segments are tokenized and aligned once.

1. Blocks of texts number their distinct segments, find those whose tokens don't
   have the segment's bytes, and write for each text its segment numbers, for each
   segment its count in sound texts.  Where the files show that only U+2581 can change
   bytes (``_kept``), only segments with it are tokenized for that, else all.
2. The distinct segments of the corpus are tokenized, many as one text, as both
   tokenizers cut between them, and their bytes compared once more.  The alignment is relational: tokens
   are exploded by position, windowed sums of lengths are ends, an equi-join on
   segment and end gives links and cuts, a running count of cuts numbers groups.
   Links of an id pair are summed with the segments' counts.
3. Each block gets the figures of its own segments back, and sums and strings
   them in the order of each text.

B's pieces must hold no space behind another character and none of the marks
behind a letter, or B could merge over a cut: loading such a model raises.  Edges: texts that are null, empty, or whose
joined bytes of A or B differ from space and text have zeros and an empty string,
and add nothing to counts; rows that repeat are aligned and counted each; other
columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Numbering, blocks, cut, discard, release

#: Bytes of text in a block.
BLOCK = 24 << 20
#: Id pairs that are sent to every task instead of shuffled: 24 bytes each.
BROADCAST_PAIRS = 1_000_000
#: Segments tokenized as one text.
CHUNK = 2000
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
LATIN, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ",.;:!?"
MARK_CUT = re.compile(rf"(?<=[{LATIN}])(?=[{MARKS}])")
#: Goes before a segment without a space, where that needs something to follow.
FILLER = " a"
#: B writes a space so; a text's own becomes a space.
SPACE = "\u2581"
#: Columns of a segment: ids and lengths in bytes of its tokens.
TOKENS = "a array<int>, a_size array<int>, b array<int>, b_size array<int>"


class Tokenizers(NamedTuple):
    """The files of both tokenizers."""

    a: str
    b: str


@functools.lru_cache(maxsize=2)
def _loaded(files: Tokenizers):
    """Both encoders and, by id, the bytes of their tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(files.a)
    a.encode_special_tokens = True
    byte_of = _byte_letters()
    a_bytes = {i: bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode() for s, i in a.get_vocab().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=files.b)
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    over = re.compile(rf"[^▁]▁|[{LATIN}][{MARKS}]")
    if any(over.search(p) for p in pieces):
        raise ValueError("a piece of tokenizer B holds a space or a mark behind another character")
    b_bytes = {i: bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)}
    return a, a_bytes, b, b_bytes


@functools.lru_cache(maxsize=2)
def _kept(files: Tokenizers) -> bool:
    """Whether the files show that both tokenizers keep all bytes of a text without
    U+2581: A is byte-level with all bytes and normalizes nothing, its added tokens are
    special ones; B normalizes nothing, too, and has a piece for each byte."""
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    a, b = json.loads(Path(files.a).read_bytes()), ModelProto.FromString(Path(files.b).read_bytes())
    split, model, norm = a["pre_tokenizer"] or {}, a["model"], b.normalizer_spec
    kinds = ModelProto.SentencePiece
    return (
        a["normalizer"] is None
        and a["truncation"] is None
        and split.get("type") == "ByteLevel"
        and not split["add_prefix_space"]
        and all(t["special"] for t in a["added_tokens"])
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        and _byte_letters().keys() <= model["vocab"].keys()
        and not norm.precompiled_charsmap
        and norm.add_dummy_prefix
        and norm.escape_whitespaces
        and not norm.remove_extra_whitespaces
        and not b.trainer_spec.treat_whitespace_as_suffix
        and {p.piece for p in b.pieces if p.type == kinds.BYTE} == {f"<0x{x:02X}>" for x in range(256)}
        and all(p.type in (kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN) for p in b.pieces)
    )


def _byte_letters() -> dict[str, int]:
    """Byte-level pieces write each byte as one character: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(other)}


def sound(segments: list[str], files: Tokenizers) -> np.ndarray:
    """Whether both tokenizers give a segment's bytes back."""
    if not _kept(files):
        return tokenized(segments, files, keep=False)[0]
    out = np.ones(len(segments), bool)
    odd = [k for k, s in enumerate(segments) if SPACE in s]
    if odd:
        out[odd] = tokenized([segments[k] for k in odd], files, keep=False)[0]
    return out


def _units(segments: list[str], numbers: list[int]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts as lists of segments with their numbers (-1: a filler).  Segments
    that end or go on with white space have a text of their own."""
    plain: list[str] = []
    own: list[int] = []
    for k in numbers:
        s = segments[k]
        before = [] if s[0] == " " else [FILLER]
        if s[-1] == " " or s[0] == " " and s[1:2].strip() == "":
            yield [*before, s], [-1, k][1 - len(before) :]
            continue
        plain += [*before, s]
        own += [-1, k][1 - len(before) :]
        if len(own) >= CHUNK:
            yield plain, own
            plain, own = [], []
    if own:
        yield plain, own


def tokenized(segments: list[str], files: Tokenizers, keep: bool = True) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Whether both tokenizers give a segment's bytes back; and with ``keep`` for
    each of them (number of the segment, id, length) of all tokens in order."""
    a, a_bytes, b, b_bytes = _loaded(files)
    sound = np.ones(len(segments), bool)
    found: list[list[tuple[np.ndarray, ...]]] = [[], []]

    def encode(parts: list[str], numbers: list[int]) -> bool:
        text = "".join(parts)
        whole, given = text.encode(), (a.encode(text, add_special_tokens=False).ids, b.encode(text[1:]))
        tokens = [[*map(of.__getitem__, ids)] for of, ids in zip((a_bytes, b_bytes), given, strict=True)]
        if any(b"".join(t) != whole for t in tokens):
            return False
        if keep:
            ends = np.cumsum([len(p.encode()) for p in parts])
            for side, ids, own in zip(found, given, tokens, strict=True):
                size = np.fromiter(map(len, own), np.int32, len(own))
                number = np.array(numbers)[np.searchsorted(ends, np.cumsum(size))]
                side.append((number[number >= 0], np.array(ids, np.int32)[number >= 0], size[number >= 0]))
        return True

    for parts, numbers in _units(segments, [*range(len(segments))]):
        if not encode(parts, numbers):
            for k in (n for n in numbers if n >= 0):
                for alone, own in _units(segments, [k]):
                    sound[k] = encode(alone, own)
    joined = [tuple(np.concatenate([x[c] for x in side]) if side else np.zeros(0, np.int32) for c in range(3)) for side in found]
    return sound, [tuple(x[np.argsort(side[0], kind="stable")] for x in side) for side in joined]


class _Odd(Exception):
    """A word that isn't a segment's beginning."""


class _Words(dict):
    """word between spaces -> numbers of the segments of a space and the word."""

    def __init__(self) -> None:
        self.number = Numbering()

    def of(self, word: str) -> tuple[int, ...]:
        return tuple(map(self.number.__getitem__, MARK_CUT.split(" " + word)))

    def __missing__(self, word: str) -> tuple[int, ...]:
        if not word or word[0].isspace():
            raise _Odd
        got = self[word] = self.of(word)
        return got

    def numbers(self, text: str) -> np.ndarray:
        try:
            found = [*map(self.__getitem__, text.split(" "))]
        except _Odd:
            found = [*map(self.of, CUT.split(text))]
        return np.fromiter(chain.from_iterable(found), np.int64)


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers by planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)


def _rows(schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _segmented(files: Tokenizers) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of texts (``numbers`` is null without tokens) and rows of segments (``k`` isn't null)."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("numbers", pa.binary()), ("k", pa.int32()), ("segment", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts in blocks(batches, BLOCK):
            # its partition and its number there, in one number
            place = [int(x) for x in name.split("-")]
            block = (place[0] << 32) + place[1]
            words = _Words()
            told = [words.numbers(t.decode()) if t else None for t in texts]
            of = [*words.number]
            good = sound(of, files)
            counts = np.zeros(len(of), np.int64)
            for k, own in enumerate(told):
                if own is None or not good[own].all():
                    told[k] = None
                else:
                    once, times = np.unique(own, return_counts=True)
                    counts[once] += times
            for at in range(0, len(ids), 1000):
                part = slice(at, at + 1000)
                blobs = [None if x is None else pack(x) for x in told[part]]
                yield _rows(schema, len(blobs), block=pa.array([block] * len(blobs), pa.int64()), doc_id=pa.array(ids[part], pa.int64()), numbers=pa.array(blobs, pa.binary()))
            used = np.flatnonzero(counts)
            for at in range(0, len(used), 50_000):
                part = used[at : at + 50_000]
                segments = pa.array([of[k] for k in part.tolist()])
                yield _rows(schema, len(part), block=pa.array([block] * len(part), pa.int64()), k=pa.array(part, pa.int32()), segment=segments, n=pa.array(counts[part]))

    return run


def _with_tokens(files: Tokenizers) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(segment, n, homes) with the columns of its tokens."""

    def listed(size: int, number: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
        ends = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=size))]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(c)) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, sides = tokenized(batch.column(0).to_pylist(), files)
            if not good.all():
                raise ValueError("a segment that was taken as sound isn't")
            lists = [c for side in sides for c in listed(batch.num_rows, *side)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=["segment", "n", "homes", "a", "a_size", "b", "b_size"])

    return run


def _ends(segments: DataFrame, side: str) -> DataFrame:
    """(id, n, end, pos, token) of the tokens of one side; pos from 1."""
    # dealt by segment before the tokens are rows: the window needs no other exchange
    both = F.arrays_zip(F.col(side).alias("token"), F.col(f"{side}_size").alias("size"))
    tokens = segments.select("id", "n", side, f"{side}_size").repartition("id").select("id", "n", F.posexplode(both).alias("pos", "t"))
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tokens.select("id", "n", F.sum("t.size").over(before).alias("end"), (F.col("pos") + 1).alias("pos"), "t.token")


def _ids(tokens: Column, cuts: Column, side: str) -> Column:
    """For each cut the ids of one side from the cut before it on, joined by commas."""
    text = tokens.cast("array<string>")

    def of(cut: Column, k: Column) -> Column:
        since = F.when(k > 0, F.get(cuts, k - 1)[side]).otherwise(0)
        return F.array_join(F.slice(text, since + 1, cut[side] - since), ",")

    return F.transform(cuts, of)


def aligned_segments(segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (id, n, homes) and the columns of tokens: figures of each segment
    (homes, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), and the id
    pairs (a, b, n, best) with the count of their links and whether it is the
    highest of b; last the table of links that the figures are made of."""
    a = _ends(segments, "a").select("id", "n", "end", F.col("pos").alias("at_a"), F.col("token").alias("a"))
    b = _ends(segments, "b").select("id", "end", F.col("pos").alias("at_b"), F.col("token").alias("b"))
    links = cut(a.join(b, ["id", "end"]), "zstd")
    pairs = links.groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = cut(pairs.join(pairs.groupBy("b").agg(F.max("n").alias("highest")), "b").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best")))
    # pairs of ids soon stop growing with the corpus; where there are more, a frequent one may be split by Spark,
    # as nothing above the join needs its rows together
    known = F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs
    counted = links.drop("n").join(known, ["a", "b"]).select("id", "end", "at_a", "at_b", "n", "best").repartition("id")
    # the running count of cuts is the number of the group that ends there; tokens without bytes end with the last one
    group = F.dense_rank().over(Window.partitionBy("id").orderBy("end"))
    each = counted.withColumn("g", group).groupBy("id", "g").agg(F.count("*").alias("n"), F.sum(F.col("best").cast("long")).alias("best"), F.sum("n").alias("sum"), F.max("at_a").alias("a"), F.max("at_b").alias("b"))
    sums = [F.count("*").alias("n_groups"), F.sum("n").alias("n_links"), F.sum("best").alias("n_best"), F.sum("sum").alias("count_sum")]
    cuts = each.groupBy("id").agg(*sums, F.array_sort(F.collect_list(F.struct("g", "a", "b"))).alias("cuts"))
    met = cuts.join(segments.select("id", "homes", "a", "b"), "id")
    both = F.zip_with(_ids(F.col("a"), F.col("cuts"), "a"), _ids(F.col("b"), F.col("cuts"), "b"), lambda x, y: F.concat_ws("|", x, y))
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in ("a", "b")]
    return met.select("homes", *sizes, "n_groups", "n_links", "n_best", "count_sum", F.array_join(both, ";").alias("groups")), pairs, links


SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _restored(texts: pa.Table, own: pa.Table, column: str, finish: Callable[[str], str]) -> pa.Table:
    """The figures of the texts of one block from those of its segments."""
    k = own.column("k").to_numpy()
    size = int(k.max()) + 1 if len(k) else 0
    figures = np.zeros((size, len(SUMS)), np.int64)
    strings = np.empty(size, object)
    for c, name in enumerate(SUMS):
        figures[k, c] = own.column(name).to_numpy()
    strings[k] = own.column("groups").to_pylist()
    sums, digests = np.zeros((texts.num_rows, len(SUMS)), np.int64), []
    for row, blob in enumerate(texts.column("numbers").to_pylist()):
        if blob is None:
            digests.append("")
            continue
        numbers = unpack(blob)
        sums[row] = figures[numbers].sum(axis=0)
        digests.append(finish(";".join(strings[numbers].tolist())))
    out = [texts.column("doc_id").combine_chunks(), *(pa.array(np.ascontiguousarray(sums[:, c])) for c in range(len(SUMS))), pa.array(digests, pa.string())]
    release()
    return pa.Table.from_arrays(out, names=["doc_id", *SUMS, column])


def segment_table(documents: DataFrame, files: Tokenizers) -> tuple[DataFrame, DataFrame]:
    """(block, doc_id, numbers) of every text, and the distinct segments: ``id``,
    ``n``, the tokens, and ``homes``, the blocks that hold it with its number
    there, so an entry for ``BLOCK`` bytes of text at most."""
    told = cut(documents.select("doc_id", "text").mapInArrow(_segmented(files), "block long, doc_id long, numbers binary, k int, segment string, n long"), "zstd")
    texts = told.where(F.col("k").isNull()).select("block", "doc_id", "numbers")
    homes = F.collect_list(F.struct(F.col("block").alias("home"), "k")).alias("homes")
    merged = told.where(F.col("k").isNotNull()).groupBy("segment").agg(F.sum("n").alias("n"), homes)
    made = merged.mapInArrow(_with_tokens(files), f"segment string, n long, homes array<struct<home:long,k:int>>, {TOKENS}")
    return texts, cut(made.select(F.monotonically_increasing_id().alias("id"), "n", "homes", "a", "a_size", "b", "b_size"), "zstd")


def align(documents: DataFrame, files: Tokenizers, digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every
    row; with ``digest`` the last column is ``groups_sha256``."""
    texts, distinct = segment_table(documents, files)
    lazy, _, links = aligned_segments(distinct)
    figures = cut(lazy, "zstd")
    # what led to the figures takes no room beside the exchange of the blocks
    for done in (links, distinct):
        discard(done)
    back = figures.select(F.inline("homes"), *SUMS, "groups")
    column = "groups_sha256" if digest else "groups"
    finish = (lambda s: sha256(s.encode()).hexdigest()) if digest else (lambda s: s)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _restored(left, right, column, finish)

    schema = f"doc_id long, {', '.join(f'{c} long' for c in SUMS)}, {column} string"
    return texts.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(run, schema)


def id_links(documents: DataFrame, files: Tokenizers) -> DataFrame:
    """(a, b, n, best): how often two ids are linked in the corpus."""
    return aligned_segments(segment_table(documents, files)[1])[1]

