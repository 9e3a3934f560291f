"""Substring search that reads little: an inverted table of trigrams beside the rows.

Every text is cut into its distinct lower-cased runs of three characters. The table of runs has, for each
field, run and block of row ids, the ascending places of the rows in the block that hold the run; the
file format keeps them as differences. A run that most rows hold is many rows of the table, one a block.
A search reads the runs of the typed text, intersects their places block by block and tests only these
rows for the text itself, so the answer is exactly that of a scan. Both tables are dealt into partitions:
the runs by a hash, the rows by ranges of the id, and only the partitions in question are opened.

A typed text of under three characters has no run and scans the rows. Null and empty fields hold no
text; the empty typed text is in every field that is not null, as in a scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions.text import contains_ci
from medialake.session import scratch_path
from medialake.sources.stored import StoredTable, hashed, ranged

GRAM = 3
BLOCK = 1 << 15  # row ids in a block of places


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case."""
    # Three characters are looked at from each one; the pattern walks on by one, also past pairs of units.
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))."), F.lit(1)))


def gram_rows(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """`field`, `gram`, `block`, `places`: where every run is, ascending within its block."""
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    texts = rows.select(F.col(id_col).alias("id"), parts.alias("x")).select("id", "x.field", "x.text")
    held = texts.filter("text is not null and id is not null").select(
        "field",
        F.explode(grams(F.col("text"))).alias("gram"),
        F.floor(F.col("id") / BLOCK).alias("block"),
        F.pmod("id", F.lit(BLOCK)).cast("int").alias("place"),
    )
    return held.groupBy("field", "gram", "block").agg(F.sort_array(F.collect_set("place")).alias("places"))


@dataclass(frozen=True)
class TrigramIndex:
    rows: StoredTable
    runs: StoredTable
    id_col: str
    fields: tuple[str, ...]

    @staticmethod
    def build(
        rows: DataFrame, id_col: str, fields: list[str], path: str, width: int = 1_000_000, parts: int = 256
    ) -> TrigramIndex:
        """Store the rows in ranges of `width` ids and their runs in `parts` partitions. Ids are whole
        numbers, each for one row; rows without an id can't be stored."""
        kept = rows.filter(F.col(id_col).isNotNull())
        stored = StoredTable.create(kept, f"{path}/rows", id_col, ranged(id_col, width))
        # Version 2 pages code whole numbers as differences.
        runs = StoredTable.create(
            gram_rows(stored.read(), id_col, fields),
            f"{path}/runs",
            "gram",
            hashed("gram", parts),
            {"parquet.writer.version": "v2", "parquet.enable.dictionary#places.list.element": "false"},
        )
        return TrigramIndex(stored, runs, id_col, tuple(fields))

    def candidates(self, typed: str, fields: list[str] | None = None) -> DataFrame | None:
        """`id` of the rows that hold every run of the typed text in one of the fields; None if the text
        is too short to have one."""
        spark = self.rows.spark
        asked = spark.range(1).select(F.explode(grams(F.lit(typed))).alias("gram"))
        wanted = [r.gram for r in asked.collect()]  # as many as the typed text has characters
        if not wanted:
            return None
        held = self.runs.read(self.runs.parts_of(asked)).filter(
            F.col("gram").isin(wanted) & F.col("field").isin(list(fields or self.fields))
        )
        lists = held.groupBy("field", "block").agg(F.collect_list("places").alias("lists"))
        both = F.aggregate(F.slice("lists", 2, len(wanted)), F.get("lists", F.lit(0)), F.array_intersect)
        found = lists.filter(F.size("lists") == len(wanted)).select("block", F.explode(both).alias("place"))
        return found.select((F.col("block") * BLOCK + F.col("place")).alias("id")).distinct()

    def search(self, typed: str, fields: list[str] | None = None) -> DataFrame:
        """The rows that hold the typed text in one of the fields, upper and lower case alike."""
        fields = list(fields or self.fields)
        hit = F.lit(False)
        for f in fields:
            hit = hit | contains_ci(f, typed)
        found = self.candidates(typed, fields)
        if found is None:
            return self.rows.read().filter(hit)
        path = scratch_path(self.rows.spark, "candidates")
        found.select(F.col("id").alias(self.id_col)).write.parquet(path)
        ids = self.rows.spark.read.schema(f"{self.id_col} long").parquet(path)
        near = self.rows.read(self.rows.parts_of(ids))
        return near.join(ids, self.id_col, "left_semi").filter(hit)
