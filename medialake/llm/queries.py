"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.llm import oracles
from medialake.llm.alignment import aligned
from medialake.llm.common import table
from medialake.llm.decontam import contained_items
from medialake.llm.filter_audit import filter_audit
from medialake.llm.jaccard_join import similar_documents
from medialake.llm.line_dedup import drop_shared_lines
from medialake.llm.pieces import sampled_pieces
from medialake.llm.pitman_yor import scored
from medialake.llm.quality import judged
from medialake.llm.secrets import scanned
from medialake.llm.sharding import read_shards, sharded, write_shards
from medialake.llm.simhash import near_duplicates
from medialake.llm.suffixes import without_repeats
from medialake.llm.token_files import read_tokens, write_tokens
from medialake.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_shared_lines(_documents(spark, sf_dir), min_chars=40, min_docs=5)
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return out.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), size=3, radius=3)


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), size=5, share=0.8)


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *counts, "base_failed", "kept", "score")


@query
def op4_histogram_sort_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards are written with their texts; the digests are of the rows read back from them."""
    docs = _documents(spark, sf_dir)
    shards = sharded(docs, n_shards=16, key="doc_id", carry={"doc_id": F.col("doc_id"), "text": F.col("text")})
    shards = shards.drop("size")
    path = scratch_path(spark, "shards")
    write_shards(shards, path)
    text = F.coalesce("text", F.lit(""))
    return read_shards(spark, path, shards.schema).select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for an owner, and a source's documents in one language for a repository."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = scanned(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    return out.withColumn("base_sha256", F.sha2(F.col("spans"), 256))


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    files = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return read_tokens(files, docs)


@query
def op7_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = sampled_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), seed=7, with_ids=False)
    return out.select("doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless")


@query
def op6_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(_documents(spark, sf_dir))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_documents(spark, sf_dir))


@query
def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit(docs, table(spark, sf_dir, "labels"), part=F.col("source"))


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_documents(spark, sf_dir), size=3, percent=90)


ORACLES: dict[str, str] = oracles.ORACLES
