"""Line dedup: lines that many documents share are dropped everywhere but in one of them.

A line's key is the line without outer ASCII white space, with A-Z folded. Keys are told apart by
two independent 64-bit hashes, so no text moves while they are counted.

Special cases: a null or empty text is one empty line. Rows that share a doc_id (null included) are
one document when documents are counted, and each row keeps its own text. A null doc_id is smaller
than all others. Other columns pass through; input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import SPACES, lower_ascii, saved


def _key(line: Column, min_chars: int) -> Column:
    """Two hashes of a line's key, null where the key is short."""
    key = lower_ascii(F.btrim(line, F.lit(SPACES)))
    pair = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
    return F.when(F.length(key) >= min_chars, pair)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_shared_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with the shared lines cut out of the text, and with `n_lines`, `n_dropped` (long).

    A key of at least `min_chars` characters found in at least `min_docs` documents keeps its lines
    in the document with the largest id only. A null text stays null unless a line of it goes.
    """
    text = F.col(text_col)
    row_hash = F.xxhash64(text)
    # Both uses below read the hashes of the lines, so they are written once.
    placed = saved(
        docs.select(
            F.col(id_col).alias("doc"),
            row_hash.alias("row"),
            F.posexplode(F.transform(_lines(text), lambda x: _key(x, min_chars))).alias("pos", "key"),
        )
        .where("key is not null")
        .select("doc", "row", "pos", "key.h1", "key.h2"),
        "lines",
    )
    # One row per distinct (key, document), then one per key. Both steps combine before their
    # shuffle, so a line that most documents hold makes no hot group.
    # Written apart, the shared keys meet all lines in a join whose hot keys the engine can split.
    shared = saved(
        placed.select("h1", "h2", "doc")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper"),
        "shared-lines",
    )
    # Only positions come back to the documents.
    gone = (
        placed.join(shared, ["h1", "h2"])
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("doc", "row")
        .agg(F.collect_set("pos").alias("gone"))
    )
    left, right = docs.alias("a"), gone.alias("b")
    here = F.col(f"a.{id_col}").eqNullSafe(F.col("b.doc")) & (F.xxhash64(F.col(f"a.{text_col}")) == F.col("b.row"))
    found = F.coalesce(F.col("b.gone"), F.array().cast("array<int>"))
    kept = F.when(
        F.size(found) > 0,
        F.array_join(F.filter(_lines(F.col(f"a.{text_col}")), lambda x, i: ~F.array_contains(found, i)), "\n"),
    ).otherwise(F.col(f"a.{text_col}"))
    made = {
        text_col: kept,
        "n_lines": F.size(_lines(F.col(f"a.{text_col}"))).cast("long"),
        "n_dropped": F.size(found).cast("long"),
    }
    rest = [F.col(f"a.{c}") for c in docs.columns if c not in made]
    joined = left.join(right, here, "left").select(*rest, *[c.alias(n) for n, c in made.items()])
    return joined.select(*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])
