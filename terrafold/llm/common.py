"""Helpers that several text operators share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII lower case as (from, to) arguments of ``translate``: other letters stay.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's
    ``spark.checkpoint.dir``; only where that is unset (tests, one machine) a
    temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = f"{tempfile.gettempdir()}/terrafold-checkpoints"
    return there.rstrip("/")


#: With this setting Spark deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start
    from files that survive a lost executor instead of from its lineage.  Shuffle
    files that only led to the table go as soon as it is written; the session's
    own setting for that is put back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    trim(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table of ``cut`` from the shared folder: for one that only led to another written table."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def releasing(work: Callable) -> Callable:
    """``work`` on the driver, after which memory that it has freed goes back to
    the system (the C library would keep it); nothing is done where that's unknown."""

    @functools.wraps(work)
    def run(*args, **named):
        out = work(*args, **named)
        release()
        return out

    return run


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trim(spark: SparkSession) -> str:
    """Have the driver's JVM give freed memory outside its heap (of its compilers and
    collector) back to the system, by its own diagnostic command; what it says, or
    nothing where it has no such command."""
    jvm = spark._jvm
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # by the interface, as the server's own class isn't open
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return ""


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the decimal doc_id (null: of the empty text), modulo ``folds``."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int
) -> DataFrame:
    """(text, label) of at most ``per_class`` training rows of each class.

    Training rows are those whose fold isn't ``held_out``.  The rows taken are
    those first in the order of a hash of doc_id, so a sample doesn't depend on
    how the tables are partitioned.  ``per_class`` bounds what a fit collects;
    scoring is never bounded by it.
    """
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & (fold_of("doc_id", folds) != held_out))
        .withColumn("at", F.xxhash64("doc_id"))
    )
    # two top-k reports (one a class), each a bounded heap per task
    both = [picked.where(F.col("label") == y).orderBy("at", "doc_id").limit(per_class) for y in (0, 1)]
    keys = both[0].unionByName(both[1]).groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # of repeated ids the least text, so that a fit doesn't depend on the order of rows
    return texts.join(F.broadcast(keys), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as bytes; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def hash64(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class HashCache(dict):
    """word -> 64-bit hash, kept for the words of one block of documents."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = hash64(word)
        return got


class Numbering(dict):
    """word -> 0, 1, 2, ... in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def pack7(keys: np.ndarray) -> bytes:
    """Keys below 2**56 in seven bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def unpack7(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(blob, np.uint8).reshape(-1, 7)
    return out.view("<u8").reshape(-1)


def pack_counts(n: np.ndarray) -> bytes:
    """A byte a count, and the counts over 254 (as 255) in full behind them."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u8").tobytes()


def unpack_counts(blob: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(blob, np.uint8, size).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<u8", offset=size)
    return out


def blocks(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[tuple[str, list, list[bytes]]]:
    """(block name, values of the first column, texts) of about ``max_bytes`` of text each.

    A block's name is its place (partition, number), so it's the same in every
    pass over the same scan, and when a lost task is run again.
    """
    from pyspark import TaskContext

    part, number, ids, texts, total = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch), strict=True):
            ids.append(doc_id)
            texts.append(text)
            total += len(text) + 16
            if total >= max_bytes:
                yield f"{part}-{number}", ids, texts
                number, ids, texts, total = number + 1, [], [], 0
    if ids:
        yield f"{part}-{number}", ids, texts
    release()


#: From batches to (part of a batch, score of each row).
Scorer = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[float]]]]


def scored(documents: DataFrame, scores: Scorer) -> DataFrame:
    """(doc_id, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in scores(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.float64())], names=["doc_id", "score"])
        release()  # the worker waits for its next task with what this one took

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def filtered(documents: DataFrame, scores: Scorer, good: Callable[[float], bool]) -> DataFrame:
    """The documents whose score is good, whole: no join brings them back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in scores(batches):
            yield part.filter(pa.array([good(s) for s in own], pa.bool_()))
        release()

    return documents.mapInArrow(run, documents.schema)
