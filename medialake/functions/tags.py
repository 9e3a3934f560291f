"""Tag-list expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medialake.functions.text import trimmed


def _lit(tag: Column | str) -> Column:
    return F.lit(tag) if isinstance(tag, str) else tag


def add_tag(tags: Column, tag: Column | str) -> Column:
    """Append the trimmed tag unless it is empty or already there."""
    t = trimmed(_lit(tag))
    skip = (t == "") | F.array_contains(tags, t)
    return F.when(skip, tags).otherwise(F.array_append(tags, t))


def remove_tag(tags: Column, tag: Column | str) -> Column:
    return F.array_remove(tags, _lit(tag))


def toggle(items: Column, item: Column | str) -> Column:
    """Take the item out when present, else append it at the end."""
    i = _lit(item)
    return F.when(F.array_contains(items, i), F.array_remove(items, i)).otherwise(
        F.array_append(items, i)
    )


def merge_tags(left: Column, right: Column) -> Column:
    """Union of two tag lists, equal up to case."""
    return F.array_distinct(F.transform(F.concat(left, right), lambda t: F.lower(t)))


def csv_tags(c: Column) -> Column:
    """Comma-separated text to a list without blanks; empty text gives an empty list."""
    return F.filter(F.transform(F.split(c, ","), lambda t: trimmed(t)), lambda t: t != "")


def preview(tags: Column, shown: int = 3) -> tuple[Column, Column]:
    """The first few tags and the number left out."""
    rest = F.greatest(F.size(tags) - F.lit(shown), F.lit(0))
    return F.slice(tags, 1, shown), rest
