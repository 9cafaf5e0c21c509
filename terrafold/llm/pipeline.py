"""A training corpus from raw documents: each stage keeps the columns of its
input, works on all that the stage before kept, and is written and reread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, mixing, quality, toxicity
from .common import cut, table
from .queries import (
    QUALITY_FOLDS,
    QUALITY_HELD_OUT,
    TOXIC_FOLDS,
    TOXIC_HELD_OUT,
    TOXIC_LIMIT,
    digests,
    tokenizer,
)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't reject."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), TOXIC_FOLDS, TOXIC_HELD_OUT)
    return toxicity.keep(docs, model, TOXIC_LIMIT)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote doesn't reject."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), QUALITY_FOLDS, QUALITY_HELD_OUT)
    return quality.keep(docs, model, 0.5)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingles with a similarity of
    0.8 or more: that of the smallest doc_id.

    Equal rows are one.  Where rows with one doc_id hold different texts, each
    text is a document of its own; of rows that differ in other columns only, the
    first by a hash stays.  All documents without words or without doc_id stay.
    """
    same = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(same).alias("least"), F.max(same).alias("last"))
    several = cut(ids.where("least <> last").select(F.col("doc_id").alias("of"), "least"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(row.alias("row"), "doc_id", F.col("text"), _order(docs).alias("order"))
    if several.limit(1).count():
        # further texts of an id get a negative number of their own
        own = -F.abs(F.xxhash64("doc_id", "same") % (1 << 62)) - 1
        rows = rows.withColumn("same", same).join(several, F.col("doc_id") == F.col("of"), "left")
        rows = rows.withColumn("doc_id", F.when(F.col("least") < F.col("same"), own).otherwise(F.col("doc_id")))
    found = jaccard_join.jaccard_components(rows.select("doc_id", "text"), n=5, percent=80, count_links=False)
    kept = found.where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    unnumbered = docs.where(F.col("doc_id").isNull())
    one = rows.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", "order").alias("row"))
    return one.select("row.*").unionByName(unnumbered)


def _order(docs: DataFrame) -> Column:
    """A hash of the columns that can be hashed."""
    return F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights, in shuffled order."""
    return mixing.mixed_rows(docs).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded texts."""
    return digests(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("ngram_jaccard", one_of_each_group),
    ("mixing", mix),
    ("byte_bpe", encode),
]
#: The stages fit models and fold merges, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's rows written and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
