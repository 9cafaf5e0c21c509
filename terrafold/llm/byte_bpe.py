"""Byte-level BPE: encoding and decoding with higher-order functions.

A text is cut by the splitting pattern.  Each piece becomes an array of its
bytes, framed by two marks, and ``aggregate`` folds ranked merges over it: an
element holds the rank of a part joined with the next one, the part's offset and
its id; every step takes the smallest element, so the leftmost pair of the smallest
rank, joins the pair and looks up the two ranks that change, until no pair has one.  Ranks come from a literal map of
pairs of ids, laid out as a perfect hash table in two literal arrays (a lookup
in one large Spark map scans it).  Frequent distinct pieces are folded once and
their ids kept in a memo of bounded size; all other pieces, which are rare, are
folded where they stand.  Decoding concatenates the binary pieces of the ids in
one pass over them.

Defined results: a null or empty text has no ids and decodes to no bytes; other
columns and repeated rows pass through (a column named as the result is
replaced); an empty table gives an empty table; very long texts are encoded
whole, in one task.  A fold of an n-byte piece takes at most n - 1 steps over at
most n + 2 elements.  A piece over ``LONG`` bytes is folded by rounds instead: a
round joins all pairs of the smallest rank, as the leftmost first would, so its
steps are the distinct ranks that occur.  Where joining one of them makes a pair of a still
smaller rank, which would come before the others, the round joins the leftmost alone.
"""

from __future__ import annotations

import base64
import json
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, releasing

#: Bits of an id or a rank; the mark that frames a piece is also the rank of pairs without one.
BITS, NONE = 18, (1 << 18) - 1
#: An element is rank | offset | id: the bits of the offset and id, and of the offset.
LOW, OFFSET = (1 << 45) - 1, (1 << 45) - (1 << 18)
#: Buckets and least places of the table of ranks.
BUCKETS, PLACES = 50_021, 150_001
#: The memo holds so many frequent pieces of at most so many bytes each, whatever the
#: input, found in about so many documents.  It saves time only: ids don't depend on it.
MEMO_LISTS = 1 << 17
MEMO_PIECES, MEMO_BYTES, MEMO_DOCUMENTS = 400_000, 64, 32_000
#: Pieces of more bytes are folded by rounds: the same ids, other costs.
LONG = 1000
#: The sign of an element that a round has joined.
JOINED = -(1 << 63)
#: The setting that bounds descriptions of plans.
PLAN_LENGTH = "spark.sql.maxPlanStringLength"


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 piece and rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


#: Unicode White_Space, which the tokenizer library means by \\s: fixed values.
WHITE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def java_pattern(pattern: str) -> str:
    """The splitting pattern for java.util.regex, whose own \\s is ASCII."""
    inside = re.sub(r"(\[\^?)((?:\\.(?:\{\w+\})?|[^\]\\])*)\]", lambda m: m[1] + m[2].replace(r"\s", WHITE) + "]", pattern)
    return inside.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Key of two ids -> rank of their pieces joined."""
    found = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            if piece[:i] in ranks and piece[i:] in ranks:
                found[ranks[piece[:i]] << BITS | ranks[piece[i:]]] = rank
    return found


def hash_table(found: dict[int, int]) -> tuple[list[int], list[int]]:
    """(shift of each bucket, places): key k stands at the place
    ``k % PLACES + shift[k % BUCKETS]``, as ``k << BITS | rank``."""
    buckets: dict[int, list[int]] = defaultdict(list)
    for key in found:
        buckets[key % BUCKETS].append(key)
    shift, taken = [0] * BUCKETS, {}
    for bucket, keys in sorted(buckets.items(), key=lambda b: (-len(b[1]), b[0])):
        at = [k % PLACES for k in keys]
        if len(set(at)) < len(at):
            raise ValueError("two pairs can't be told apart")
        while any(a + shift[bucket] in taken for a in at):
            shift[bucket] += 1
        taken.update((a + shift[bucket], k << BITS | found[k]) for a, k in zip(at, keys, strict=True))
    empty = 1 << (3 * BITS)  # no key's entry
    return shift, [taken.get(i, empty) for i in range(PLACES + max(shift))]


class ByteBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_pieces: int = MEMO_PIECES):
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        if max(ranks.values()) >= NONE:
            raise ValueError(f"ids need at most {BITS} bits")
        self.pattern, self.memo_pieces, self._ranks = java_pattern(pattern), memo_pieces, ranks
        self._written: DataFrame | None = None

    # -- literals ---------------------------------------------------------
    def rank_map(self) -> Column:
        """The literal rank map: struct of ``shift``, ``place`` and the ids of the ``byte`` values."""
        shift, place = hash_table(pair_ranks(self._ranks))
        return F.struct(
            _literal(shift, "array<bigint>").alias("shift"),
            _literal(place, "array<bigint>").alias("place"),
            _literal([self._ranks[bytes([b])] for b in range(256)], "array<bigint>").alias("byte"),
        )

    def vocabulary(self) -> Column:
        """The binary piece of each id, as a literal array."""
        pieces = [""] * (max(self._ranks.values()) + 1)
        for piece, rank in self._ranks.items():
            pieces[rank] = base64.b64encode(piece).decode()
        return _literal(pieces, "array<binary>")

    @releasing
    def constant(self, df: DataFrame, name: str) -> Column:
        """The literal ``ranks`` or ``vocabulary``, as a constant that is read from a written
        row: in the plans themselves they'd be printed whole into each description.  A
        subquery can't stand inside a higher-order function; as a column of its own, used
        once, the optimizer puts it there."""
        if self._written is None:
            self._written = cut(df.sparkSession.range(1).select(self.rank_map().alias("ranks"), self.vocabulary().alias("vocabulary")))
        return self._written.select(name).scalar()

    # -- the fold ---------------------------------------------------------
    def fold(self, piece: Column, table: Column) -> Column:
        """ids of one piece."""
        bits = lambda x, mask: x.bitwiseAND(F.lit(mask).cast("long"))

        def element(pair: Column) -> Column:
            # of offset | id | next id: the rank of both ids above offset | id; other keys' entries differ above the rank
            key = bits(pair, (1 << 2 * BITS) - 1)
            entry = F.get(table["place"], key % F.lit(PLACES) + F.get(table["shift"], key % F.lit(BUCKETS)))
            rank = F.least(entry.bitwiseXOR(F.shiftleft(key, BITS)), F.lit(NONE).cast("long"))
            return F.shiftleft(rank, 45).bitwiseOR(F.shiftright(pair, BITS))

        def merge(parts: Column, at: Column, least: Column) -> Column:
            # the pair at `at` (from 1, never the first) becomes the part whose id is its rank
            joined = F.shiftright(least, 45)
            before = F.shiftleft(bits(F.get(parts, at - 2), LOW), BITS).bitwiseOR(joined)
            after = F.shiftleft(bits(least, OFFSET).bitwiseOR(joined), BITS).bitwiseOR(bits(F.get(parts, at + 1), NONE))
            return F.flatten(F.array(F.slice(parts, F.lit(1), at - 2), F.transform(F.array(before, after), element), F.slice(parts, at + 2, F.size(parts))))

        def step(parts: Column, least: Column) -> Column:
            # the smallest element is the leftmost of the smallest rank; offsets rise, so those before it are counted
            # (array_position leaves its loop by an exception, which costs more than the whole step)
            at = _let(bits(least, LOW), lambda low: F.size(F.filter(parts, lambda e: bits(e, LOW) < low)) + 1)
            return F.when(least >= F.lit(NONE << 45), parts).otherwise(_let(at, lambda at: merge(parts, at, least)))

        def chosen(parts: Column, least: Column) -> Column:
            # the pairs of the least rank that are joined, going left to right: of two that share a part the first
            rank = F.shiftright(least, 45)
            hit = lambda e: F.shiftright(e, 45) == rank
            shared = F.exists(F.transform(parts, lambda e, i: hit(e) & hit(F.get(parts, i - 1))), lambda x: x)
            marks = F.array_join(F.transform(parts, lambda e: F.when(hit(e), "1").otherwise("0")), "")
            apart = F.transform(F.split(F.replace(marks, F.lit("11"), F.lit("10")), ""), lambda c: c == "1")
            return F.when(shared, apart).otherwise(F.transform(parts, hit))

        def at_once(parts: Column, least: Column, taken: Column) -> Column:
            # all chosen pairs joined; null where one of them makes a pair that comes before the others
            joined, floor = F.shiftright(least, 45), bits(least, NONE << 45)
            # until the next pair is joined, too, a part stands before that pair's first half
            early = F.exists(
                F.transform(parts, lambda e, i: F.get(taken, i) & (element(F.shiftleft(joined, BITS).bitwiseOR(bits(F.get(parts, i + 2), NONE))) < floor)),
                lambda x: x,
            )
            marked = F.transform(parts, lambda e, i: F.when(F.get(taken, i), bits(e, OFFSET).bitwiseOR(joined).bitwiseOR(F.lit(JOINED))).otherwise(e))
            left = F.filter(marked, lambda e, i: ~F.coalesce(F.get(taken, i - 1), F.lit(False)))

            def again(left: Column) -> Column:
                def one(e: Column, i: Column) -> Column:
                    after = F.coalesce(F.get(left, i + 1), F.lit(NONE).cast("long"))
                    return F.when((e < 0) | (after < 0), element(F.shiftleft(bits(e, LOW), BITS).bitwiseOR(bits(after, NONE)))).otherwise(e)

                return F.transform(left, one)

            whole = _let(left, again)
            return F.when(early, None).otherwise(_let(whole, lambda out: F.when(F.array_min(out) >= floor, out)))

        def round_of(state: Column) -> Column:
            def on(parts: Column, least: Column) -> Column:
                every = _let(chosen(parts, least), lambda taken: at_once(parts, least, taken))
                return F.struct(F.coalesce(every, step(parts, least)).alias("parts"), F.lit(False).alias("done"))

            def open_(parts: Column) -> Column:
                least = F.array_min(parts)
                ended = F.struct(parts.alias("parts"), F.lit(True).alias("done"))
                return _let(least, lambda least: F.when(least >= F.lit(NONE << 45), ended).otherwise(on(parts, least)))

            return F.when(state["done"], state).otherwise(open_(state["parts"]))

        chars = F.split(F.decode(piece.cast("binary"), "ISO-8859-1"), "")
        mark = F.lit(NONE).cast("long")
        ids = F.concat(F.array(mark), F.transform(chars, lambda c: F.get(table["byte"], F.ascii(c))), F.array(mark, mark))
        pair = lambda ids, i: F.shiftleft(F.shiftleft(i.cast("long"), BITS).bitwiseOR(F.get(ids, i)), BITS).bitwiseOR(F.get(ids, i + 1))
        start = _let(ids, lambda ids: F.transform(F.sequence(F.lit(0), F.size(ids) - 2), lambda i: element(pair(ids, i))))
        steps = F.sequence(F.lit(2), F.greatest(F.octet_length(piece), F.lit(2)))
        inner = lambda parts: F.transform(F.slice(parts, F.lit(2), F.size(parts) - 2), lambda e: bits(e, NONE).cast("int"))
        short = F.aggregate(steps, start, lambda parts, _: _let(F.array_min(parts), lambda least: step(parts, least)), inner)
        begun = F.struct(start.alias("parts"), F.lit(False).alias("done"))
        long = F.aggregate(steps, begun, lambda state, _: round_of(state), lambda state: inner(state["parts"]))
        return F.when(F.octet_length(piece) > LONG, long).otherwise(short)

    # -- operators --------------------------------------------------------
    def pieces(self, text: Column) -> Column:
        """The matches of the splitting pattern."""
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def frequent(self, df: DataFrame, text: str = "text") -> DataFrame:
        """(piece, ids) of at most MEMO_PIECES pieces that are frequent in about
        MEMO_DOCUMENTS documents: what the memo holds, not what is encoded."""
        top = (
            df.sample(min(1.0, MEMO_DOCUMENTS / max(1, df.count())), seed=7)
            .select(F.explode(self.pieces(F.col(text))).alias("piece"))
            .groupBy("piece")
            .count()
            .where((F.octet_length("piece") <= MEMO_BYTES) & (F.col("count") > 1))
            .orderBy(F.desc("count"), "piece")
            .limit(self.memo_pieces)
            .select("piece")
        )
        # written first, so that the plan with the literals is small and planned once
        spread = cut(top.repartition(4 * df.sparkSession.sparkContext.defaultParallelism))
        held = spread.withColumn("ranks", self.constant(df, "ranks"))
        return held.select("piece", _let(F.col("ranks"), lambda table: self.fold(F.col("piece"), table)).alias("ids"))

    def memo(self, df: DataFrame, text: str = "text") -> Column:
        """An array of small maps, each of the pieces of a list to their ids, as a constant."""
        one = F.map_from_entries(F.collect_list(F.struct("piece", "ids")))
        lists = self.frequent(df, text).groupBy(_list_of(F.col("piece")).cast("long").alias("id")).agg(one.alias("known"))
        every = df.sparkSession.range(MEMO_LISTS).join(lists, "id", "left")
        # maps have no order, so the lists are ordered by their numbers alone
        lists = F.array_sort(F.collect_list(F.struct("id", "known")), lambda a, b: (a["id"] - b["id"]).cast("int"))
        return cut(every.agg(lists.alias("lists")).select(F.col("lists.known").alias("memo"))).scalar()

    def ids_of(self, text: Column, held: Column) -> Column:
        """The ids of a text; ``held`` has the ``memo`` and the ``ranks``."""

        def one(t: Column, piece: Column) -> Column:
            return F.coalesce(F.get(t["memo"], _list_of(piece))[piece], self.fold(piece, t["ranks"]))

        return _let(held, lambda t: F.flatten(F.transform(self.pieces(text), lambda p: one(t, p))))

    def bytes_of(self, ids: Column, vocabulary: Column) -> Column:
        """The bytes of ids.  A string here is any run of bytes: the binary pieces are
        joined in one pass, not by a copy for each id."""
        return _let(vocabulary, lambda v: F.array_join(F.transform(ids, lambda i: F.get(v, i).cast("string")), "").cast("binary"))

    def tables(self, df: DataFrame, text: str) -> Column:
        """The memo and the ranks, as a column of its own that is used once."""
        if df.sparkSession.conf.get(PLAN_LENGTH, None) is None:
            df.sparkSession.conf.set(PLAN_LENGTH, "100000")
        return F.struct(self.memo(df, text).alias("memo"), self.constant(df, "ranks").alias("ranks"))

    def both(self, df: DataFrame, result, text: str = "text") -> DataFrame:
        """``df`` with the columns of ``result``, a struct of ids and decoded bytes.  In one
        expression, as a table that is a column of its own between two steps is copied for each row."""
        held, vocabulary, to = _unused(df, 3)
        rows = df.withColumns({held: self.tables(df, text), vocabulary: self.constant(df, "vocabulary")})
        made = _let(self.ids_of(F.col(text), F.col(held)), lambda ids: _let(self.bytes_of(ids, F.col(vocabulary)), lambda decoded: result(ids, decoded)))
        return rows.withColumn(to, made).select(*(F.col(f"`{c}`") for c in df.columns), f"{to}.*")

    def encode(self, df: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """``df`` with a column of ids."""
        (held,) = _unused(df, 1)
        return df.withColumn(held, self.tables(df, text)).withColumn(ids, self.ids_of(F.col(text), F.col(held))).drop(held)

    def decode(self, df: DataFrame, ids: str = "ids", to: str = "decoded") -> DataFrame:
        """``df`` with the bytes of a column of ids."""
        (held,) = _unused(df, 1)
        return df.withColumn(held, self.constant(df, "vocabulary")).withColumn(to, self.bytes_of(F.col(ids), F.col(held))).drop(held)


def _unused(df: DataFrame, n: int) -> list[str]:
    """Names that no column has."""
    return [c for c in (f"_held{i}" for i in range(len(df.columns) + n)) if c not in df.columns][:n]


def _list_of(piece: Column) -> Column:
    return F.xxhash64(piece).bitwiseAND(MEMO_LISTS - 1).cast("int")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: the end of a fold over nothing
    (an item of a transformed array would have its type derived for every row)."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def _literal(values: list, kind: str) -> Column:
    """A bounded table as a literal: the optimizer folds the JSON into its value,
    so tasks get the value."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)
