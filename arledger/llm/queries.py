"""The registered queries of the operators, and SQL that DuckDB can run for those that SQL can express.

Every query reads its whole table; ``QUERIES`` maps names to callables (spark, sf_dir) -> DataFrame.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import audit, chat, common, decontamination, jaccard, langid, linededup, mixing, packing, prefixcounts, repetition, sharding, sql, toxicity, turntrie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SHARDS = 40
PIECES, BYTES, BYTES_END = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken", 50256
MOST_TOKENS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, oracle: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            common.shipped(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = query
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


@register("op1_repetition_rules", sql.REPETITION)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and line measures and the suffix-array verdict of every document."""
    found = repetition.repetition(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op2_wu_manber", sql.HITS)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of benchmark windows, and the items found."""
    return decontamination.digest(decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@register("op3_snapshot_collapse", sql.CHAT)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return chat.render(table(spark, sf_dir, "conversations"))


@register("op4_count_vector_jaccard", sql.JACCARD)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set, and its component of links."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


@register("op5_language_fusion")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page."""
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@register("op6_bloom_line_dedup", sql.LINES)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many repeat an earlier document's, and the digest of the others."""
    return linededup.line_dedup(table(spark, sf_dir, "documents"))


@register("op7_packed_rows")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids in matrices of 4,096 columns."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), public_tokenizers.PATTERN, BYTES_END)


@register("op8_prefix_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over the token limit."""
    return prefixcounts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), MOST_TOKENS)


@register("op9_jump_shards", sql.SHARDS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and shard after growth of every document, by law ``key``."""
    return sharding.slots(table(spark, sf_dir, "documents"), SHARDS)


@register("op10_poisson_mix", sql.MIXTURE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all sources at square-root weights, whole rows with the number of the copy."""
    return mixing.replicate(table(spark, sf_dir, "documents"))


@register("op11_prefix_trie", sql.TRIE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix tree of the rebuilt conversations."""
    return turntrie.nodes(turntrie.rebuilt(table(spark, sf_dir, "conversations")))


@register("op12_filter_audit", sql.AUDIT)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of every order of five filters keeps, removes and repeats, per language."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op13_factorization_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
