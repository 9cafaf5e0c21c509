"""Line deduplication over a corpus by sorted line hashes.

1. Every line that is long enough gives 128 bits of hash with its document and
   position; the rows are written once.
2. They are range-partitioned by hash and sorted by hash, document (largest
   first) and position.  A pass over each range streams first occurrences: a row
   starts a document where the one before it has another doc_id, the first
   document of a hash keeps its lines, and a hash with enough documents loses all
   others.  A hash that holds a great share of the rows is cut into slices of
   documents that lie in different ranges, and its few sums are merged.
3. What goes back to a document is a sparse bitmap of 64-bit words, and only of
   documents that lose a line; the text itself meets it once.

Only DataFrame functions.  Edges: a null or empty text is one empty line;
documents are told apart by doc_id, so rows that repeat an id count as one
document and each row loses its own lines; a null doc_id is one document, less
than all others; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut

#: What is stripped from both ends of a line.
SPACE = " \t\n\u000b\f\r"
#: A hash with more rows than this share of all (and than HOT_ROWS) is cut into slices: fewer than HOT_KEYS can be.
HOT_KEYS, HOT_ROWS = 20_000, 50_000
ROW = ["doc_id", "t1", "t2"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(x: Column) -> list[Column]:
    """Two seeded 64-bit hashes."""
    return [F.xxhash64(x), F.xxhash64(F.lit(1), x)]


def _texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text, t1, t2): the hash of the text tells rows of one id apart."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t1, t2 = _hash(F.col("text"))
    return texts.withColumn("t1", t1).withColumn("t2", t2)


def keyed_lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, t1, t2, pos) of every line whose key has ``min_chars`` code points."""
    lines = _texts(documents).select(*ROW, F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(SPACE)), UPPER, LOWER)
    h1, h2 = _hash(F.col("key"))
    return lines.select(*ROW, "pos", key.alias("key")).where(F.length("key") >= min_chars).select(h1.alias("h1"), h2.alias("h2"), *ROW, "pos")


def _sliced(lines: DataFrame) -> DataFrame:
    """``slice``: -1, and for a hash with very many rows a number dealt by document."""
    hot = max(HOT_ROWS, lines.count() // HOT_KEYS)
    heavy = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > hot).withColumn("slices", F.ceil(F.col("n") / hot)).drop("n")
    # fewer than HOT_KEYS rows, as each stands for more than 1 / HOT_KEYS of all
    dealt = F.pmod(F.xxhash64("doc_id"), F.col("slices"))
    return lines.join(F.broadcast(heavy), ["h1", "h2"], "left").withColumn("slice", F.coalesce(dealt, F.lit(-1)).cast("int")).drop("slices")


def dropped_lines(documents: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    """(doc_id, t1, t2, pos) of the lines that go."""
    lines = cut(keyed_lines(documents, min_chars))
    key = ["h1", "h2", "slice"]
    order = [F.col("doc_id").desc_nulls_last(), F.col("pos")]
    ranged = _sliced(lines).repartitionByRange(*key).sortWithinPartitions(*key, *order)
    stream = Window.partitionBy(*key).orderBy(*order)
    same = F.lag(F.struct("doc_id")).over(stream).eqNullSafe(F.struct("doc_id"))
    whole = Window.partitionBy(*key)
    seen = ranged.withColumn("first", (~same).cast("int")).withColumn("n", F.sum("first").over(whole)).withColumn("top", F.max("doc_id").over(whole))
    # a row for each sliced hash, so fewer than HOT_KEYS
    sums = seen.where((F.col("slice") >= 0) & (F.col("first") == 1)).groupBy("h1", "h2").agg(F.count("*").alias("all_n"), F.max("doc_id").alias("all_top"))
    known = seen.join(F.broadcast(sums), ["h1", "h2"], "left")
    hot = F.col("slice") >= 0
    n, top = F.when(hot, F.col("all_n")).otherwise(F.col("n")), F.when(hot, F.col("all_top")).otherwise(F.col("top"))
    return known.where((n >= min_documents) & ~F.col("doc_id").eqNullSafe(top)).select(*ROW, "pos")


def drop_bitmaps(documents: DataFrame, min_chars: int = 40, min_documents: int = 5) -> DataFrame:
    """(doc_id, t1, t2, dropped): ``dropped`` holds the words of a bitmap that have
    a bit, as (word, bits) in order; lines of absent words all stay."""
    bit = F.expr("shiftleft(1L, pos % 64)")
    gone = dropped_lines(documents, min_chars, min_documents).repartition(*ROW)
    words = gone.groupBy(*ROW, F.expr("pos div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def _positions(dropped: Column) -> Column:
    """The numbers of the dropped lines, in order."""
    of = lambda w: F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.getbit(w["bits"], b) == 1, (w["word"] * 64 + b).cast("int"))), lambda p: p.isNotNull())
    return F.flatten(F.transform(dropped, of))


def dedup_lines(documents: DataFrame, min_chars: int = 40, min_documents: int = 5) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, dropped, kept) of every row: ``kept`` is the text without its dropped lines."""
    bitmaps = drop_bitmaps(documents, min_chars, min_documents)
    texts = _texts(documents).alias("x")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ROW]
    # the side that is built in memory holds a bit a line at most
    met = texts.join(bitmaps.alias("b").hint("shuffle_hash"), same[0] & same[1] & same[2], "left").select("x.doc_id", "x.text", "b.dropped")
    numbered = met.withColumn("lines", _lines(F.col("text"))).withColumn("gone", _positions(F.col("dropped")))
    edges = lambda: (F.concat(F.array(F.lit(-1)), F.col("gone")), F.concat(F.col("gone"), F.array(F.size("lines"))))
    after, before = edges()
    runs = F.transform(F.arrays_zip(after.alias("after"), before.alias("before")), lambda e: F.slice(F.col("lines"), e["after"] + 2, e["before"] - e["after"] - 1))
    return numbered.select(
        "doc_id",
        "text",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        "dropped",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n")).alias("kept"),
    )
