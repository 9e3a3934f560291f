"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio against a trusted target.

Words and word pairs of all documents are hashed into `buckets` cells. Two smoothed multinomials over
the cells are counted, one from the documents that are labelled good (the trusted target), one from
all documents (the raw corpus). The target is fitted on the first `max_trusted` good documents by a
hash of their ids, a stated bound, so their ids can be sent to all tasks; the raw corpus is counted
over every document. A document's score is the mean over its n-grams of the logarithm of
their ratio; a document is kept if no base rule fails and its score reaches the threshold.

Everything is built-in functions. The driver sees `buckets` counts for each of the two models, a
number set by a parameter.

Special cases: a null text has no word and fails the base rule. A document labelled good in any of
its label rows is trusted; label rows with a null id or quality count for nothing. Without a trusted
document every score is 0. Rows that share a doc_id are judged one by one. Other columns pass
through; input columns named like an added one are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import SPACES

# The rules' symbols and limits.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[ \t-\r]+", -1))


def _pairs(hashes: Column) -> Column:
    """A hash of each element and its successor."""
    n = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), lambda a, b: F.xxhash64(a, b))


def _hashed(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with its words, their hashes and the hashes of word pairs, each computed once."""
    return (
        docs.withColumn("__words", words(F.col(text_col)))
        .withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
        .withColumn("__pairs", _pairs(F.col("__hashes")))
    )


def _cell(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    full = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return _let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(pairs: Column) -> Column:
    """Words that lie in a window of three words found twice or more."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            # Equal windows are neighbours now; each is compared with the one before and after it.
            none = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("i")))
            n = F.size(s)
            around = F.arrays_zip(
                s.alias("x"),
                F.concat(none, F.slice(s, 1, n - 1)).alias("before"),
                F.concat(F.slice(s, 2, n - 1), none).alias("after"),
            )
            twice = F.filter(
                around, lambda z: z["x"]["h"].eqNullSafe(z["before"]["h"]) | z["x"]["h"].eqNullSafe(z["after"]["h"])
            )
            return F.flatten(F.transform(twice, lambda z: F.array(*[z["x"]["i"] + k for k in range(3)])))

        return F.size(F.array_distinct(_let(placed, marked)))

    def of(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered(windows)).otherwise(0)

    return _let(_pairs(pairs), of).cast("long")


def target_ratios(
    docs: DataFrame, labels: DataFrame, buckets: int, prior: float, max_trusted: int, id_col: str, text_col: str
) -> list[float]:
    """The logarithm of trusted over raw probability for every cell."""
    good = (
        labels.groupBy(F.col(id_col).alias("label_id"))
        .agg(F.max("quality").alias("quality"))
        .where("quality = 1 and label_id is not null")
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(max_trusted)
        .select("label_id")
    )
    joined = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(
        F.broadcast(good), F.col("doc") == F.col("label_id"), "left"
    )
    hashes = _hashed(joined, "text").select(
        F.col("label_id").isNotNull().alias("trusted"), F.explode(F.concat("__hashes", "__pairs")).alias("h")
    )
    cells = hashes.select(_cell(F.col("h"), buckets).alias("cell"), "trusted")
    raw, trusted = [0] * buckets, [0] * buckets
    for cell, is_trusted, n in cells.groupBy("cell", "trusted").count().select("cell", "trusted", "count").collect():
        raw[cell] += n
        trusted[cell] += n if is_trusted else 0
    if not any(trusted):
        return [0.0] * buckets
    # Smoothing is `prior` n-grams a cell in the raw corpus and their share in the trusted target, so
    # that a cell of few n-grams, of which chance may have put none into the target, says little.
    rate = sum(trusted) / sum(raw)
    return [math.log((t / rate + prior) / (r + prior)) for t, r in zip(trusted, raw, strict=True)]


def judged(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = 1 << 16,
    prior: float = 50.0,
    threshold: float = -0.1,
    max_trusted: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`docs` with the base counts, `base_failed`, `score` and `kept`."""
    ratios = target_ratios(docs, labels, buckets, prior, max_trusted, id_col, text_col)
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    text = F.col(text_col)
    hashed = _hashed(docs, text_col)
    n_words = F.size("__words").cast("long")
    total = F.aggregate(
        F.concat("__hashes", "__pairs"), F.lit(0.0), lambda acc, h: acc + F.get(table, _cell(h, buckets))
    )
    out = hashed.withColumns(
        {
            "n_words": n_words,
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long"),
            "n_dup_lines": duplicate_lines(text),
            "n_repeat_words": repeated_words(F.col("__pairs")),
            "score": F.when(n_words > 0, F.round(total / (2 * n_words - 1), 6)),
        }
    ).drop("__words", "__hashes", "__pairs")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False))
    )


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The rows of `docs` that are kept, as they are, whatever their columns are called.

    Rejected rows leave through an explode: a filter would be moved below the counts it depends on,
    with the words cut anew for each of them.
    """
    packed = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("whole")
    )
    known = labels.select(F.col(id_col).alias("doc_id"), "quality")
    whole = F.explode(F.when(F.col("kept"), F.array("whole"))).alias("whole")
    return judged(packed, known, **rules).select(whole).select("whole.*")
