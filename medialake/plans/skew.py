"""Joining to a grouped side when keys may be hot.

Joins whose two sides are shuffled as they are need nothing from here: the engine splits a large
partition of such a join at run time. It does not where one side was just grouped by the join key,
as that side has no shuffle of its own. Those joins go through ``join_lookup``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def join_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join rows to a frame with at most one row per key, whatever the spread of the keys.

    Rows of one key, null among them, are dealt over ``SALTS`` parts and every lookup row is copied
    to each part. Both sides get a shuffle of their own, so the engine can split what is still large.
    """
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))
    salted = rows.withColumn("_salt", salt)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return salted.join(lookup.withColumn("_salt", copies), [*keys, "_salt"], how).drop("_salt")
