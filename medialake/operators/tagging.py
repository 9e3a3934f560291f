"""Tag usage, tag lists of assets, and tag suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake import catalogs as C
from medialake.functions import tags as T
from medialake.functions.text import contains_ci
from medialake.plans.ordering import sequenced
from medialake.plans.skew import join_lookup

_RANKS = 64  # ranked tags in a block


def tag_usage(photos: DataFrame) -> DataFrame:
    """Number of photos per tag; a tag repeated on one photo counts once."""
    return (
        photos.select(F.explode(F.array_distinct("tags")).alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("usage"))
    )


def tags_by_usage(tags: DataFrame, category: str | None = None, query: str = "") -> DataFrame:
    """Most used tags first, optionally of one category or containing a text."""
    if category:
        tags = tags.filter(F.col("category") == category)
    if query:
        tags = tags.filter(contains_ci("tag", query))
    return tags.orderBy(F.desc("usage"), "tag")


def tag_preview(photos: DataFrame, shown: int = 3) -> DataFrame:
    """The first tags as hash tags and the count of the others."""
    head, rest = T.preview(F.col("tags"), shown)
    return photos.select(
        "photo_id",
        F.when(F.size(head) > 0, F.concat(F.lit("#"), F.array_join(head, " #")))
        .otherwise("")
        .alias("shown"),
        F.when(rest > 0, F.concat(F.lit("+"), rest.cast("string"))).otherwise("").alias("more"),
    )


def edit_tags(
    photos: DataFrame, add: Column | str | None = None, remove: Column | str | None = None
) -> DataFrame:
    """Add one tag, then take one out."""
    tags = F.col("tags")
    if add is not None:
        tags = T.add_tag(tags, add)
    if remove is not None:
        tags = T.remove_tag(tags, remove)
    return photos.withColumn("tags", tags)


def toggle_tag(photos: DataFrame, tag: Column | str) -> DataFrame:
    return photos.withColumn("tags", T.toggle(F.col("tags"), tag))


def ranked_tags(usage: DataFrame, query: str) -> DataFrame:
    """`block`, `names`: the tags that hold the typed text, most used first, in blocks of `_RANKS`.

    Tags are numbered within one usage and beginning, so that no task sees them all.
    """
    found = usage.filter(contains_ci("tag", query)).select("tag", (-F.col("usage")).alias("_less"))
    step = F.struct("_less", F.substring("tag", 1, 2).alias("_begins"))
    numbered = sequenced(found, [], ["_less", "tag"], step)
    place = F.struct("seq", "tag")
    return numbered.groupBy(F.floor((F.col("seq") - 1) / _RANKS).alias("block")).agg(
        F.transform(F.sort_array(F.collect_list(place)), lambda x: x["tag"]).alias("names")
    )


def tag_candidates(photos: DataFrame, usage: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Known tags containing the typed text and not yet on the photo, at most ``k`` per photo.

    The matching tags are ranked once, on the usage table. A photo can rule out no more of them than
    it carries, so it looks only at the blocks with that many and ``k`` of the first ranks: nearly
    always the first block, and then nothing is grouped by photo.
    """
    if not query.strip():
        return photos.select("photo_id", F.array().cast("array<string>").alias("candidates"))
    empty = F.array().cast("array<string>")
    last = F.floor((F.size("tags") + k - 1) / _RANKS)
    rows = photos.select("photo_id", F.coalesce("tags", empty).alias("tags")).withColumn("_last", last)
    asked = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("block"))
    met = join_lookup(asked, ranked_tags(usage, query), ["block"])
    left = met.withColumn("found", F.array_except(F.coalesce("names", empty), "tags"))
    one = left.filter("_last = 0").select("photo_id", F.slice("found", 1, k).alias("candidates"))
    # Photos with very many tags: their blocks in order, repeated photos as often as they are there.
    many = (
        left.filter("_last > 0")
        .groupBy("photo_id", "tags")
        .agg(F.sort_array(F.collect_set(F.struct("block", "found"))).alias("parts"), F.count_if(F.col("block") == 0).alias("n"))
        .select(
            "photo_id",
            F.slice(F.flatten(F.col("parts.found")), 1, k).alias("candidates"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_turn"),
        )
    )
    return one.unionByName(many.drop("_turn"))


def merged_tags(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Tag lists of two sources united per key, equal up to case."""
    empty = F.array().cast("array<string>")
    r = right.select(key, F.col("tags").alias("_more"))
    return left.select(key, "tags").join(r, key, "full").select(
        key, T.merge_tags(F.coalesce("tags", empty), F.coalesce("_more", empty)).alias("tags")
    )


# Every suggestion has a plain score and, where something can raise it, a raised one. All of these
# are known beforehand, so they are ranked once: a photo's suggestions are then just as many ranks.
_BONUS = {"camera": C.CAMERA_BOOST, "location": C.LOCATION_BOOST}


def _bonus(name: str, category: str) -> float:
    return C.GOLDEN_HOUR_BOOST if name == "golden-hour" else _BONUS.get(category, 0.0)


_SCORES = sorted(
    {
        (-(base + extra), seq, name, category)
        for seq, name, base, category in C.TAG_SUGGESTIONS
        for extra in (0.0, _bonus(name, category))
    }
)
_RANK = {(seq, -order): i for i, (order, seq, _, _) in enumerate(_SCORES)}


def _rank(seq: int, name: str, base: float, category: str) -> Column:
    """Rank of one suggestion for the photo in the row."""
    plain = F.lit(_RANK[seq, base])
    bonus = _bonus(name, category)
    if not bonus:
        return plain
    if category in ("camera", "location"):
        held = F.lower(category)
        raised = (held != "") & F.contains(F.lit(name.lower()), held)
    else:
        raised = (F.col("hour") >= 16) | (F.col("hour") <= 8)
    return F.when(raised, F.lit(_RANK[seq, base + bonus])).otherwise(plain)


def suggestions(assets: DataFrame) -> DataFrame:
    """Scored suggestions of the fixed catalogue per photo, best first: names and confidences.

    Scores start from the catalogue and rise when the suggestion's name contains the photo's camera
    or location, or in the golden hours. They may pass 1. Everything happens inside the row, on small
    whole numbers, and the lookups are written out one by one so that they are compiled.
    """
    ranked = assets.select("photo_id", _ranks().alias("_r"))
    names = F.array(*[F.lit(name) for _, _, name, _ in _SCORES])
    scores = F.array(*[F.lit(-order) for order, _, _, _ in _SCORES])
    places = [F.get("_r", F.lit(i)) for i in range(len(C.TAG_SUGGESTIONS))]
    return ranked.select(
        "photo_id",
        F.array(*[F.get(names, p) for p in places]).alias("names"),
        F.array(*[F.get(scores, p) for p in places]).alias("confidences"),
    )


def _ranks() -> Column:
    return F.sort_array(F.array(*[_rank(*s) for s in C.TAG_SUGGESTIONS]))


def _entries() -> Column:
    """What each rank stands for."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(category).alias("category"),
                F.lit(-order).alias("confidence"),
            )
            for order, _, name, category in _SCORES
        ]
    )


def suggestion_rows(assets: DataFrame, query: str = "", category: str = "all") -> DataFrame:
    """One row per photo and suggestion with its place, optionally searched or of one category."""
    wanted = [
        i
        for i, (_, _, name, kind) in enumerate(_SCORES)
        if category in ("all", kind) and query.lower() in name.lower()
    ]
    rows = assets.select("photo_id", F.posexplode(_ranks()).alias("pos", "_r")).filter(
        F.col("_r").isin(wanted)
    )
    return rows.select(
        "photo_id", (F.col("pos") + 1).alias("rank"), F.get(_entries(), F.col("_r")).alias("s")
    ).select("photo_id", "rank", "s.name", "s.category", "s.confidence")
