"""Secret scans: candidate spans, and how many owners and repositories hold each candidate.

Candidates are found by fixed patterns in whole texts. Each candidate's value is hashed, and over the
whole corpus the distinct repositories and owners of each hash are counted: a value that many owners
hold is an example that was copied around, a value of few owners looks like a live credential.
Values leave the row only as hashes.

Everything is built-in functions. A place is worked out from the lengths of what lies between the
matches, so a text is cut by a pattern once for the pieces and once for the matches, and only if it
holds one at all.

Special cases: a null text is empty. Null owners and null repositories each count as one. Rows that
share a doc_id are separate rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import saved

# The kinds in their order, with pattern, group of the value and its least length. The
# bounds of access keys and hex runs are in the patterns: a shorter run never hides a longer one.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]

_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _spans(text: Column, kind: int) -> Column:
    """The matches of one kind, by place; what fails the length of the value is left out."""
    _, pattern, group, least = KINDS[kind]
    regex = F.lit(pattern)
    found = F.arrays_zip(
        F.regexp_extract_all(text, regex, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, regex, F.lit(group)).alias("value"),
        # The piece after the last match is of no use.
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
    )
    start = F.struct(F.lit(0).alias("stop"), F.array().cast(_SPAN).alias("spans"))

    def add(acc: Column, m: Column) -> Column:
        begin = acc["stop"] + m["gap"]
        stop = begin + F.length(m["whole"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), m["value"].alias("value"))
        good = F.length(m["value"]) >= least
        return F.struct(
            stop.alias("stop"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans")
        )

    matches = F.filter(found, lambda m: m["whole"].isNotNull())
    return F.when(F.regexp_like(text, regex), F.aggregate(matches, start, add)["spans"]).otherwise(
        F.array().cast(_SPAN)
    )


def _named(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), kind + 1)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _named(s["kind"]), s["start"], s["stop"])), ",")


def found_secrets(
    docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`doc_id`, `owner`, `repository` and `spans` (start, kind, stop, h1, h2) of every row.

    `h1`, `h2` are two independent hashes of the value, which itself stays behind.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.array_sort(F.concat(*[_spans(text, k) for k in range(len(KINDS))]))
    hashed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["kind"].alias("kind"),
            s["stop"].alias("stop"),
            F.xxhash64(s["value"]).alias("h1"),
            F.xxhash64(F.lit(1), s["value"]).alias("h2"),
        ),
    )
    return docs.select(
        F.col(id_col).alias("doc_id"), owner.alias("owner"), repository.alias("repository"), hashed.alias("spans")
    )


def ownership(found: DataFrame) -> DataFrame:
    """`h1`, `h2`, `n_owners`, `n_repositories` of every candidate value.

    Both counts go over distinct (value, owner, repository) rows, combined before they move, so a
    value in any share of the documents is no hot group.
    """
    held = found.select("owner", "repository", F.inline("spans")).select("h1", "h2", "owner", "repository").distinct()
    pairs = held.groupBy("h1", "h2", "owner").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_owners"))
    repositories = (
        held.select("h1", "h2", "repository").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_repositories"))
    )
    return owners.join(repositories, ["h1", "h2"])


def scanned(
    docs: DataFrame,
    owner: Column,
    repository: Column,
    shared_owners: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a document: `doc_id`, counts by kind, `spans`, and the verdicts over the corpus.

    `n_copied` are spans whose value at least `shared_owners` owners hold, `n_live` the others;
    `live_spans` are these others. `max_owners` is the largest number of owners of one of its values.
    """
    found = saved(
        found_secrets(docs, owner, repository, id_col, text_col).withColumn("row", F.monotonically_increasing_id()),
        "secrets",
    )
    placed = found.select("row", F.inline("spans"))
    # Written apart, so that the rows of a value that very many texts hold can be split in the join.
    owners = saved(ownership(found), "ownership")
    judged = (
        placed.join(owners, ["h1", "h2"])
        .groupBy("row")
        .agg(
            F.count_if(F.col("n_owners") >= shared_owners).alias("n_copied"),
            F.count_if(F.col("n_owners") < shared_owners).alias("n_live"),
            F.max("n_owners").alias("max_owners"),
            F.max("n_repositories").alias("max_repositories"),
            F.array_sort(
                F.collect_list(F.when(F.col("n_owners") < shared_owners, F.struct("start", "kind", "stop")))
            ).alias("live"),
        )
    )

    def of(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    zero = F.lit(0).cast("long")
    return found.join(judged, "row", "left").select(
        "doc_id",
        *[of(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)],
        span_text(F.col("spans")).alias("spans"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_copied", "n_live", "max_owners", "max_repositories")],
        F.coalesce(span_text(F.col("live")), F.lit("")).alias("live_spans"),
    )
