"""The queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, chat, divergence, jaccard_join, licenses, line_dedup, line_rules, mixing, ngram_lm, quality, toxicity
from .byte_bpe import ByteBpe, read_ranks
from .common import fold_of, table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
ALIGNED_FILES = "byte_bpe_50k.json", "piece_bpe_32k.model"
QUALITY_FOLDS, QUALITY_HELD_OUT = 3, 1
TOXIC_FOLDS, TOXIC_HELD_OUT, TOXIC_LIMIT = 4, 2, 0.3
LM_FOLDS, LM_HELD_OUT = 7, 2
REPLY_SCHEMA: chat.Schemas = {"reply": {"chars": ("integer", True)}}


def op1_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit_quality(documents, table(spark, sf_dir, "labels"), QUALITY_FOLDS, QUALITY_HELD_OUT)
    return _classified(quality.score_quality(documents, model), QUALITY_FOLDS, QUALITY_HELD_OUT, 0.5)


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).withColumn("mix_rate", F.round("mix_rate", 9)).withColumn("mix_order", F.round("mix_order", 12))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id", "n_links")


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(chat.turns_as_calls(table(spark, sf_dir, "conversations")), REPLY_SCHEMA)


def op5_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op6_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_texts(table(spark, sf_dir, "documents"), LM_FOLDS, LM_HELD_OUT)


def op7_template_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(table(spark, sf_dir, "documents")).drop("cleaned")


def op9_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(documents, table(spark, sf_dir, "labels"), TOXIC_FOLDS, TOXIC_HELD_OUT)
    return _classified(toxicity.score_toxicity(documents, model), TOXIC_FOLDS, TOXIC_HELD_OUT, TOXIC_LIMIT)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer())


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_documents=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = alignment.Tokenizers(*map(public_tokenizers.path, ALIGNED_FILES))
    return alignment.align(table(spark, sf_dir, "documents"), files, digest=True)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), min_documents=10, top=10)


def tokenizer() -> ByteBpe:
    return ByteBpe(read_ranks(public_tokenizers.path(RANK_FILE)), public_tokenizers.PATTERN)


def digests(documents: DataFrame, bpe: ByteBpe) -> DataFrame:
    """Encode, decode, and the digests of both."""

    def of(ids: Column, decoded: Column) -> Column:
        return F.struct(
            F.size(ids).cast("long").alias("n_tokens"),
            F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
            F.sha2(decoded, 256).alias("decoded_sha256"),
        )

    return bpe.both(documents.select("doc_id", "text"), of).drop("text")


def _classified(scored: DataFrame, folds: int, held_out: int, limit: float) -> DataFrame:
    return scored.select(
        "doc_id",
        (fold_of("doc_id", folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_neighbours,
        op2_poisson_mixing,
        op3_ngram_jaccard,
        op4_tool_calls,
        op5_anisotropic_search,
        op6_backoff_automaton,
        op7_template_licenses,
        op8_line_rules,
        op9_toxicity_machine,
        op10_byte_bpe,
        op11_line_dedup,
        op12_tokenizer_alignment,
        op13_source_divergence,
    )
}
