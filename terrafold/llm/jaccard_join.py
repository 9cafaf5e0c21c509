"""Jaccard join of word shingles by vertical partitioning.

Documents are sets of word n-grams.  All n-grams have one global order, that of
their 64-bit hashes, which is cut into ranges: the fragments.  The join goes like this:

1. Byte-equal texts form classes; only the smallest doc_id of a class goes on.
2. Texts form blocks, and a block sends each fragment its part of every set.
   A fragment counts documents for its n-grams and sends back, for each block,
   how many n-grams of a document no other document holds, and its other
   n-grams with their counts.  Sums over fragments give a document's unshared
   n-grams: with more of them than a link allows it has no partner at all.
3. The documents that are left sort their shared n-grams by the number of documents
   that hold them, then by hash.  Two that link must share an n-gram of their prefixes.  First each prefix n-gram links
   its documents to its most central one; candidates' sets are cut by fragment,
   the overlaps of each pair counted in each fragment and summed.  Then only
   pairs that share a prefix n-gram and are not yet in one component are counted,
   so a group of near copies isn't expanded into all its pairs.  A bitmap of
   each set bounds the difference of two sets from below.  The documents of such
   an n-gram meet in blocks of bounded size, large components in blocks of their
   own that don't meet each other, and only pairs that may link leave a block.
4. Components take their smallest doc_id; classes and repeated rows join them.
5. Both documents of a link are in one component, so links are counted within
   components: documents of equal sets form classes with a weight, a component is
   dealt to blocks of bounded size, each two blocks meet in one task, all overlaps
   of their documents are matrix products, and only counts leave the task.

Defined results: texts that are null or hold no word have an empty set and link with
nothing, each its own component; texts shorter than n words are one n-gram;
rows that repeat a doc_id are returned as often as they stand, and with different
texts each row is a document of its own, linked by its own text; rows without a doc_id have the size of
their set, link with nothing and have no component; very long texts are read whole;
other columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashCache, blocks, cut, hash64, mix, pack7, pack_counts, unpack7, unpack_counts, utf8

BLOCK_BYTES = 16 << 20
#: Text bytes that a fragment stands for (about a million n-grams).
FRAGMENT_BYTES = 8 << 20
#: The least number of fragments: with 256, what a fragment doesn't know of a hash has seven bytes.
LEAST_FRAGMENTS = 256
#: Fragments of the pairs' overlaps, as bits of a hash.
PAIR_BITS = 3
#: Parts into which the rows of one key are dealt.
SALTS = 8
#: Classes with more than a thousandth of all rows are broadcast: there are fewer than that.
HOT_SHARE = 1000
#: 64-bit words of a set's bitmap; more of them rule out more pairs, links don't depend on it.
BITMAP = 16
#: Documents of a block in which those of an n-gram meet.
MEETING = 1024
#: Documents of a block in which links are counted (a large component has up to WIDE in a block),
#: blocks of a component until they are that wide, and n-grams of a block.
NARROW, WIDE, SIDES, BLOCK_GRAMS = 128, 4096, 16, 1 << 19
#: Documents and n-grams of a matrix product.
TILE = 1024
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, n: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out = mix(out * _MULTIPLIER + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def sets_of(texts: list[bytes], n: int) -> list[np.ndarray]:
    cache = HashCache()
    return [shingles(t, n, cache) for t in texts]


def _set_sizes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x) for x in sets_of(utf8(batch), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_shingles"])

    return run


def _fragment(grams: np.ndarray, fragments: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def _least_gram(fragment: int, fragments: int) -> np.uint64:
    return np.uint64(-(-(fragment << 32) // fragments) << 32)


def _sizes(n: np.ndarray) -> bytes:
    """A number a document of a block."""
    return len(n).to_bytes(4, "little") + pack_counts(n)


def _sizes_back(blob: bytes) -> np.ndarray:
    return unpack_counts(blob[4:], int.from_bytes(blob[:4], "little"))


def _send(n: int, fragments: int):
    """Blocks to fragments: n-grams to their own; ids and sizes under a negative number, a block's own."""
    schema = pa.schema([("fragment", pa.int32()), ("block", pa.string()), ("docs", pa.binary()), ("sizes", pa.binary()), ("grams", pa.binary())])

    def row(fragment: int, name: str, docs: bytes, sizes: np.ndarray, grams: bytes) -> pa.RecordBatch:
        values = [[fragment], [name], [docs], [_sizes(sizes)], [grams]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts in blocks(batches, BLOCK_BYTES):
            sets = sets_of(texts, n)
            sizes = np.array([len(s) for s in sets], np.int64)
            grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            doc = np.repeat(np.arange(len(sets)), sizes)
            yield row(-1 - (hash64(name.encode()) >> 34), name, np.array(ids, "<i8").tobytes(), sizes, b"")
            own = _fragment(grams, fragments)
            order = np.argsort(own, kind="stable")  # by document within a fragment
            cuts = np.searchsorted(own[order], np.arange(fragments + 1))
            for fragment in range(fragments):
                part = order[cuts[fragment] : cuts[fragment + 1]]
                if len(part):
                    yield row(fragment, name, b"", np.bincount(doc[part], minlength=len(sets)), pack7(grams[part] - _least_gram(fragment, fragments)))

    return run


def _count(group: pa.Table) -> pa.Table:
    """One fragment: document counts of its n-grams, told to each block; ids and sizes pass."""
    rows = group.to_pylist()
    if rows[0]["fragment"] < 0:
        return pa.table(
            {
                "block": [r["block"] for r in rows],
                "fragment": pa.array([-1] * len(rows), pa.int32()),
                "docs": pa.array([r["docs"] for r in rows], pa.binary()),
                "unshared": pa.array([r["sizes"] for r in rows], pa.binary()),
                "grams": pa.array([b""] * len(rows), pa.binary()),
                "holders": pa.array([b""] * len(rows), pa.binary()),
            }
        )
    grams = [unpack7(r["grams"]) for r in rows]
    _, inverse, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    holders = count[inverse]
    out: dict[str, list] = {k: [] for k in ("docs", "unshared", "grams", "holders")}
    at = 0
    for r, own in zip(rows, grams, strict=True):
        sizes = _sizes_back(r["sizes"])
        doc, n = np.repeat(np.arange(len(sizes)), sizes), holders[at : at + len(own)]
        at += len(own)
        alone = n == 1
        out["unshared"].append(_sizes(np.bincount(doc[alone], minlength=len(sizes))))
        out["docs"].append(_sizes(np.bincount(doc[~alone], minlength=len(sizes))))
        out["grams"].append(pack7(own[~alone]))
        out["holders"].append(np.minimum(n[~alone], 2**31 - 1).astype("<i4").tobytes())
    return pa.table(
        {"block": [r["block"] for r in rows], "fragment": pa.array([r["fragment"] for r in rows], pa.int32())}
        | {k: pa.array(v, pa.binary()) for k, v in out.items()}
    )


TOLD = "block string, fragment int, docs binary, unshared binary, grams binary, holders binary"
KEPT = "doc_id long, n_shingles long, unshared long, grams array<long>, bits array<long>"


def _gather(fragments: int, percent: int):
    """One block: sets in global order of the documents that may have a partner;
    the others without n-grams."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        head = next(r for r in rows if r["fragment"] < 0)
        ids, sizes = np.frombuffer(head["docs"], "<i8"), _sizes_back(head["unshared"])
        unshared = np.zeros(len(ids), np.int64)
        docs, keys, holders = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for r in rows:
            if r["fragment"] >= 0:
                unshared += _sizes_back(r["unshared"])
                docs.append(np.repeat(np.arange(len(ids)), _sizes_back(r["docs"])))
                keys.append(unpack7(r["grams"]) + _least_gram(r["fragment"], fragments))
                holders.append(np.frombuffer(r["holders"], "<i4").astype(np.int64))
        doc, key, count = np.concatenate(docs), np.concatenate(keys), np.concatenate(holders)
        # a partner must share at least percent/100 of the set
        hopeful = (100 * (sizes - unshared) >= percent * sizes) & (sizes > 0)
        own = hopeful[doc]
        doc, key, count = doc[own], key[own], count[own]
        order = np.lexsort((key, count, doc))
        doc, key = doc[order], key[order]
        starts = np.searchsorted(doc, np.arange(len(ids) + 1))
        filled = np.concatenate([[0], np.cumsum(starts[1:] > starts[:-1])])
        lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.astype(np.int64)))
        return pa.table(
            {"doc_id": ids, "n_shingles": sizes, "unshared": unshared, "grams": lists(starts, key), "bits": lists(BITMAP * filled, _bitmaps(filled[doc], key, filled[-1]))}
        )

    return run


def _bitmaps(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """The bitmaps of n sets, one after another."""
    bit = mix(key * _MULTIPLIER) % np.uint64(64 * BITMAP)
    out = np.zeros(n * BITMAP, np.uint64)
    np.bitwise_or.at(out, doc * BITMAP + (bit // np.uint64(64)).astype(np.int64), np.uint64(1) << (bit % np.uint64(64)))
    return out


def _meetings(percent: int):
    """Pairs of two blocks of an n-gram that may link: of different components, with
    enough n-grams from the shared one on, and bitmaps that don't differ too much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x_at, x), (y_at, y) = _lists(batch.column(0)), _lists(batch.column(1))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row, same in enumerate(batch.column(2).to_pylist()):
                i = slice(x_at[row], x_at[row + 1])
                j = slice(y_at[row], y_at[row + 1])
                col = lambda name: x[name][i][:, None]  # noqa: E731, B023
                both = col("n") + y["n"][j]
                reach = np.minimum(col("place"), y["place"][j]) + np.minimum(col("shared") - col("place"), y["shared"][j] - y["place"][j])
                left = (100 - percent) * both - (100 + percent) * (col("u") + y["u"][j])
                open_ = (col("c") != y["c"][j]) & (reach * (100 + percent) >= percent * both) & (left >= 0)
                if same:
                    open_ = np.triu(open_, 1)
                p, q = np.nonzero(open_)
                for at in range(0, len(p), 1 << 18):
                    pc, qc = p[at : at + (1 << 18)], q[at : at + (1 << 18)]
                    apart = np.bitwise_count(x["bits"][i][pc] ^ y["bits"][j][qc]).sum(1, dtype=np.int64)
                    near = (100 + percent) * apart <= left[pc, qc]
                    a.append(x["doc_id"][i][pc[near]])
                    b.append(y["doc_id"][j][qc[near]])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "right_b"])

    return run


def _lists(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where each row's documents start, and their fields."""
    offsets, docs = column.offsets.to_numpy(), column.flatten()
    fields = {f.name: docs.field(f.name) for f in docs.type}
    bits = fields.pop("bits").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITMAP)
    return offsets - offsets[0], {k: v.to_numpy(zero_copy_only=False) for k, v in fields.items()} | {"bits": bits}


def _least_overlap(na: Column, nb: Column, percent: int) -> Column:
    """Smallest overlap o with 100 o >= percent (na + nb - o)."""
    return F.ceil((na + nb) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps in each fragment (a range of the n-grams'
    order), summed per pair."""
    asked = pairs.select(F.explode(F.array("a", "right_b")).alias("doc_id")).distinct()
    fragment = lambda g: F.shiftrightunsigned(g, 64 - PAIR_BITS).cast("int")
    part = (
        sets.join(asked, "doc_id", "left_semi")
        .select("doc_id", "n_shingles", F.explode(F.sequence(F.lit(0), F.lit((1 << PAIR_BITS) - 1))).alias("f"), "grams")
        .select("doc_id", "n_shingles", "f", F.filter("grams", lambda g: fragment(g) == F.col("f")).alias("part"))
    )
    left = part.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), "f", F.col("part").alias("pa"))
    right = part.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("f").alias("g"), F.col("part").alias("pb"))
    counted = (
        pairs.join(left, "a")
        .join(right, (F.col("right_b") == F.col("b")) & (F.col("f") == F.col("g")))
        .select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).cast("long").alias("overlap"))
        .groupBy("a", "b", "na", "nb")
        .agg(F.sum("overlap").alias("overlap"))
    )
    return counted.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the links (a, b): the smallest node
    reachable.  Labels spread along links and along labels themselves, so the
    number of rounds is about the logarithm of a component's width."""
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("component")))
    while True:
        told = both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("hearer")).agg(F.min("component").alias("heard"))
        heard = labels.join(told, labels.node == told.hearer).select("node", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        # all of a giant component may go through one node: rows are dealt by a salt, and only nodes
        # that would change a label are asked
        jump = labels.where(F.col("component") < F.col("node")).select(
            F.col("node").alias("via"), F.col("component").alias("further"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        )
        dealt = heard.withColumn("deal", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        after = cut(
            dealt.join(jump, (F.col("component") == F.col("via")) & (F.col("deal") == F.col("salt")), "left").select(
                "node", "was", F.least("component", F.coalesce("further", "component")).alias("component")
            )
        )
        if after.where(F.col("component") < F.col("was")).limit(1).count() == 0:
            return after.select("node", "component")
        labels = after.select("node", "component")


def _overlaps(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray) -> np.ndarray:
    """Common n-grams of each document of x and of y (sorted by document, from x_at and y_at on)."""
    common = np.intersect1d(x, y)
    out = np.zeros((len(x_at) - 1, len(y_at) - 1), np.float32)

    def places(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = np.searchsorted(common, grams)
        known = column < len(common)
        known[known] = common[column[known]] == grams[known]
        column, doc = column[known], np.repeat(np.arange(len(at) - 1), np.diff(at))[known]
        order = np.argsort(column, kind="stable")
        return column[order], doc[order]

    (cx, dx), (cy, dy) = places(x, x_at), places(y, y_at)
    for c in range(0, len(common), TILE):
        sides = []
        for column, doc, n in ((cx, dx, len(x_at) - 1), (cy, dy, len(y_at) - 1)):
            own = slice(*np.searchsorted(column, [c, c + TILE]))
            m = np.zeros((n, min(TILE, len(common) - c)), np.float32)
            m[doc[own], column[own] - c] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _links_within(percent: int):
    """(doc_id, links) of the documents of two blocks of a component, or of one
    block of whole components with itself."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("number", "ascending"), ("c", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        number, c, n, weight = (group[k].to_numpy() for k in ("number", "c", "n_shingles", "weight"))
        lists = group["grams"].chunk(0)
        at = lists.offsets.to_numpy().astype(np.int64)
        grams, at = lists.flatten().to_numpy(), at - at[0]
        links = np.zeros(len(n), np.int64)
        starts = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (c[1:] != c[:-1]), True])
        parts = [slice(a, b) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        across = group["p"][0].as_py() != group["q"][0].as_py()  # one of the two blocks may be empty
        for i, j in [tuple(parts)] * (len(parts) == 2) if across else [(own, own) for own in parts]:
            for a in range(i.start, i.stop, TILE):
                for b in range(j.start if across else a, j.stop, TILE):
                    p, q = slice(a, min(a + TILE, i.stop)), slice(b, min(b + TILE, j.stop))
                    x_at, y_at = at[p.start : p.stop + 1], at[q.start : q.stop + 1]
                    both = n[p][:, None] + n[q]
                    o = _overlaps(grams[x_at[0] : x_at[-1]], x_at, grams[y_at[0] : y_at[-1]], y_at).astype(np.int64)
                    linked = 100 * o >= percent * (both - o)
                    if p == q:
                        np.fill_diagonal(linked, False)
                    else:
                        links[q] += linked.T @ weight[p]
                    links[p] += linked @ weight[q]
        return pa.table({"doc_id": group["doc_id"], "links": links})

    return run


def _link_counts(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(node, n_links): the links of each document of the components ``found``."""
    # sets without unshared n-grams may be equal
    equal = F.when(F.col("unshared") == 0, F.concat_ws(":", F.xxhash64("grams"), F.hash("grams"))).otherwise(F.concat_ws(":", F.lit("one"), "doc_id"))
    members = cut(sets.join(found, F.col("doc_id") == F.col("node")).select("doc_id", F.col("component").alias("c"), equal.alias("equal"), F.size("grams").alias("k")))
    classes = cut(members.groupBy("c", "equal").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight"), F.max("k").alias("k")))
    wide = F.least(F.greatest(F.col("m") / SIDES, F.lit(float(NARROW))), F.lit(float(WIDE)))
    sizes = cut(classes.groupBy("c").agg(F.count("*").alias("m"), F.sum("k").alias("k")).withColumn("sides", F.greatest(F.ceil(F.col("m") / wide), F.ceil(F.col("k") / BLOCK_GRAMS))))
    few = sizes.where("sides = 1").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    bins = max(1, -(-few["m"] // NARROW), -(-few["k"] // BLOCK_GRAMS))
    # a component of several blocks has more than NARROW documents or BLOCK_GRAMS n-grams: they are few
    large = F.broadcast(sizes.where("sides > 1").select("c", "sides"))
    many = F.col("sides").isNotNull()
    number = F.when(many, F.pmod(F.xxhash64("doc_id"), F.col("sides"))).otherwise(F.pmod(F.xxhash64("c"), F.lit(bins)))
    other = F.explode(F.when(many, F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)).otherwise(F.array("number")))
    counted = (
        sets.select("doc_id", "n_shingles", "grams")
        .join(classes.select("doc_id", "c", "weight"), "doc_id")
        .join(large, "c", "left")
        .withColumn("number", number)
        .withColumn("other", other)
        .select("doc_id", "c", "weight", "n_shingles", "grams", "number", F.when(many, F.col("c")).alias("whole"), F.least("number", "other").alias("p"), F.greatest("number", "other").alias("q"))
        .groupBy("whole", "p", "q")
        .applyInArrow(_links_within(percent), "doc_id long, links long")
        .groupBy("doc_id")
        .agg(F.sum("links").alias("links"))
    )
    of_class = classes.join(counted, "doc_id").select("c", "equal", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    return members.join(of_class, ["c", "equal"]).select(F.col("doc_id").alias("node"), "n_links")


def jaccard_components(documents: DataFrame, n: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``documents``;
    n_links counts the other texts that a row's text links to (byte-equal texts are
    one).  Without ``count_links`` that column is left out."""
    everything = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = everything.where(F.col("doc_id").isNotNull())
    classes = cut(rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("same")))
    # a class goes by its smallest doc_id; where two classes share that (an id with several texts), all but one by a negative number
    least = classes.groupBy("same").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    owner = least.groupBy("least").agg(F.min("same").alias("owner"))
    own = F.when(F.col("same") == F.col("owner"), F.col("least")).otherwise(-F.abs(F.xxhash64("same") % (1 << 62)) - 1)
    first = cut(least.join(owner, "least").select("same", own.alias("doc_id"), "least", "rows"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    fragments = max(LEAST_FRAGMENTS, -(-size // FRAGMENT_BYTES))
    # one text a class, in an order of its own: a task that is run again makes the same blocks
    same = F.md5(F.col("text").cast("binary"))
    of_first = rows.withColumn("same", same).join(first.select(F.col("doc_id").alias("key"), F.col("least").alias("doc_id"), "same"), ["doc_id", "same"])
    texts = of_first.groupBy("doc_id", "same").agg(F.min("key").alias("key"), F.min("text").alias("text")).select(F.col("key").alias("doc_id"), "text").sortWithinPartitions("doc_id")
    sent = texts.mapInArrow(_send(n, fragments), "fragment int, block string, docs binary, sizes binary, grams binary")
    told = sent.groupBy("fragment").applyInArrow(_count, TOLD)
    kept = cut(told.groupBy("block").applyInArrow(_gather(fragments, percent), KEPT))
    sets = kept.where(F.size("grams") > 0)

    # prefixes: an n-gram at place p (from 0) of the shared ones is in the prefix if p < room
    room = F.col("n_shingles") - F.floor((F.col("n_shingles") * percent + 99) / 100).cast("long") + 1 - F.col("unshared")
    prefix = cut(
        sets.withColumn("room", F.greatest(room, F.lit(0)).cast("int")).select(
            "doc_id", "n_shingles", "unshared", F.size("grams").alias("shared"), F.posexplode(F.slice("grams", F.lit(1), F.col("room"))).alias("place", "gram")
        )
    )
    # the most central document of an n-gram has the smallest share of unshared n-grams
    centre = prefix.groupBy("gram").agg(
        F.min(F.struct((F.col("unshared") / F.col("n_shingles")).alias("share"), F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("unshared").alias("ub"))).alias("c"),
        F.count("*").alias("many"),
    ).where(F.col("many") > 1).select("gram", "c.b", "c.nb", "c.ub")
    bound = _least_overlap(F.col("n_shingles"), F.col("nb"), percent)
    stars = (
        prefix.join(centre, "gram")
        .where((F.col("doc_id") != F.col("b")) & (F.least(F.col("n_shingles") - F.col("unshared"), F.col("nb") - F.col("ub")) >= bound))
        .select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("right_b"))
        .distinct()
    )
    tried = cut(stars)
    links = cut(_verified(tried, sets, percent))
    found = components(links)

    # the rest: pairs of different components that share a prefix n-gram
    placed = prefix.join(found, F.col("doc_id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "doc_id")).drop("node", "component")
    of_side = placed.groupBy("gram", "c").agg(F.count("*").alias("m"))
    small = F.when(F.col("m") <= MEETING, F.col("m"))
    of_gram = of_side.groupBy("gram").agg(F.coalesce(F.sum(small), F.lit(0)).alias("few"), F.count("*").alias("sides")).where("sides > 1").drop("sides")
    large = F.col("m") > MEETING
    number = F.when(large, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("m") / MEETING))).otherwise(F.pmod(F.xxhash64("c"), F.ceil(F.col("few") / MEETING)))
    doc = F.struct("doc_id", "c", F.col("n_shingles").alias("n"), F.col("unshared").alias("u"), F.col("place").cast("long").alias("place"), F.col("shared").cast("long").alias("shared"), "bits")
    meeting = cut(
        placed.join(of_side.join(of_gram, "gram"), ["gram", "c"])
        .join(sets.select("doc_id", "bits"), "doc_id")
        .groupBy("gram", F.when(large, F.col("c")).alias("whole"), number.alias("number"))
        .agg(F.collect_list(doc).alias("docs"))  # about MEETING documents
        .withColumn("block", F.struct(F.coalesce("whole", F.lit(-(2**63))).alias("whole"), "number"))
    )
    x = meeting.select("gram", F.col("block").alias("bx"), F.col("docs").alias("x"), F.col("whole").alias("wx"))
    y = meeting.select("gram", F.col("block").alias("by"), F.col("docs").alias("y"), F.col("whole").alias("wy"))
    rest = (
        x.join(y, "gram")
        .where((F.col("bx") <= F.col("by")) & ~F.coalesce(F.col("wx") == F.col("wy"), F.lit(False)))
        .select("x", "y", (F.col("bx") == F.col("by")).alias("same"))
        .mapInArrow(_meetings(percent), "a long, right_b long")
        .distinct()
        .join(tried, ["a", "right_b"], "left_anti")
    )
    more = cut(_verified(rest, sets, percent))
    all_links = links.unionByName(more)
    final = components(all_links) if more.limit(1).count() else found

    # classes and repeated rows take over from their smallest document
    # a component may go by a negative number: those that do, and their smallest doc_id
    named = final.join(first.select("doc_id", "least"), F.col("node") == F.col("doc_id")).groupBy("component").agg(F.min("least").alias("smallest")).where("smallest <> component")
    final = cut(final.join(named, "component", "left").select("node", "component", F.coalesce("smallest", "component").alias("smallest")))
    of_first = kept.select(F.col("doc_id").alias("first"), "n_shingles").dropDuplicates(["first"]).join(final.select(F.col("node").alias("first"), "smallest"), "first", "left")
    if count_links:
        of_first = of_first.join(_link_counts(sets, final.select("node", "component"), percent).withColumnRenamed("node", "first"), "first", "left")
    counts = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    of_class = cut(first.withColumnRenamed("doc_id", "first").join(of_first, "first", "left"))
    # a class may hold a third of all rows: the few large ones meet their rows by broadcast
    hot = of_class.where(F.col("rows") > F.lit(classes.count() // HOT_SHARE + HOT_SHARE))
    cold = classes.join(F.broadcast(hot.select("same")), "same", "left_anti").join(of_class, "same")
    joined = classes.join(F.broadcast(hot), "same").unionByName(cold).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("smallest", "least")).alias("component_id"),
        *counts,
    )
    sized = everything.where(F.col("doc_id").isNull()).mapInArrow(_set_sizes(n), "doc_id long, n_shingles long")
    none = sized.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), *([F.lit(0).cast("long").alias("n_links")] if count_links else []))
    return joined.unionByName(none)
