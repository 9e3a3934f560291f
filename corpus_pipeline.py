"""A corpus pipeline: quality rules, line dedup, SimHash near-dedup, decontamination, SentencePiece.

Each stage takes the documents its predecessor kept and returns documents with the same columns, the
last one with sampled pieces added. A stage's result is written and read again before the next.

Rows are told apart by doc_id and text, so rows that share a doc_id are judged one by one; of rows
alike in both, near-dedup keeps one. Extra columns of the documents are carried along whatever their
names; where the text changes, `n_chars` follows it if there is one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medialake.llm import decontam, line_dedup, pieces, quality, simhash
from medialake.llm.common import saved, table

# Fingerprints of 256 bits over five-word shingles. Texts of similarity 0.8 share shingles at an angle
# whose expected distance is 39 bits with a deviation of 6; unrelated texts are 128 bits apart. They
# are compared where texts share one of their first hashes, as all near copies do, and only search: two
# texts are near copies if they share `_SHARE` of their distinct shingles exactly.
_WORDS, _RADIUS, _TILE, _SHARE = 4, 60, 32_768, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share go from all but one of them."""
    packed = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"))
    out = line_dedup.drop_shared_lines(packed)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("rest.n_chars"))
        changed["n_chars"] = chars.cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays; null ids come last."""
    key = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64("text"))
    found = simhash.near_duplicates(
        docs.select(key.alias("doc_id"), "text"), size=5, radius=_RADIUS, n_words=_WORDS, tile=_TILE, share=_SHARE
    )
    keepers = found.select(F.col("component_id").alias("keeper")).distinct()
    whole = docs.select(key.alias("key"), F.struct(*docs.columns).alias("whole"))
    kept = whole.join(keepers, F.col("key") == F.col("keeper"), "left_semi")
    # Rows alike in id and text have one key; the first of them stays.
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("whole")))
    return kept.withColumn("turn", first).where("turn = 1").select("whole.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_sampling(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets a sampled segmentation that decodes to its text."""
    return pieces.sampled_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), seed=7)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_sampling),
]

# Fingerprints and sampled pieces have no counterpart in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
