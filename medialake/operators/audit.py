"""Audit analytics: daily metrics, key states, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake import catalogs as C
from medialake.plans.skew import join_lookup


def daily_metrics(audit: DataFrame) -> DataFrame:
    """Issued, renewed, failed and revoked per day with the renewal success rate."""
    op = F.col("op")
    renewals = F.count_if(op == "ROTATE")
    renewed = F.count_if((op == "ROTATE") & F.col("succeeded"))
    return audit.groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(op == "STORE").alias("issued"),
        renewals.alias("renewals"),
        F.round(F.try_divide(renewed * F.lit(100.0), renewals), 2).alias("renewal_success_rate"),
        F.count_if(op == "DELETE").alias("revoked"),
        F.count_if(op == "FAIL").alias("failed_attempts"),
    )


def key_lifetimes(audit: DataFrame) -> DataFrame:
    """Per key: first issue, first revocation after it and the seconds between."""
    issued = audit.groupBy("key").agg(
        F.min(F.when(F.col("op") == "STORE", F.col("ts"))).alias("issued_at")
    )
    revoked = audit.filter(F.col("op") == "DELETE").select("key", "ts")
    after = (
        join_lookup(revoked, issued, ["key"], "inner")
        .filter(F.col("ts") >= F.col("issued_at"))
        .groupBy("key")
        .agg(F.min("ts").alias("revoked_at"))
    )
    return issued.join(after, "key", "left").select(
        "key",
        "issued_at",
        "revoked_at",
        F.timestamp_diff("SECOND", F.col("issued_at"), F.col("revoked_at")).alias("seconds_to_revocation"),
    )


def lifetime_summary(lifetimes: DataFrame) -> DataFrame:
    """Keys issued and revoked, with the mean and shortest time to revocation in seconds."""
    seconds = F.col("seconds_to_revocation")
    return lifetimes.agg(
        F.count("issued_at").alias("issued"),
        F.count("revoked_at").alias("revoked"),
        F.try_divide(F.sum(seconds), F.count(seconds)).alias("mean_seconds"),
        F.min(seconds).alias("shortest_seconds"),
    )


def key_states(audit: DataFrame, order: list[str]) -> DataFrame:
    """Current state per key: last change, rotations so far and whether it is revoked."""
    change = F.col("op").isin("STORE", "ROTATE", "DELETE")
    return (
        audit.filter(change)
        .groupBy("key")
        .agg(
            F.max_by("op", F.struct(*order)).alias("last_op"),
            F.max("ts").alias("changed_at"),
            F.count_if(F.col("op") == "ROTATE").alias("rotations"),
        )
        .withColumn("revoked", F.col("last_op") == "DELETE")
    )


def expiry_band(days_left: Column) -> Column:
    """``expired``, the tightest warning that applies, or ``valid``."""
    band = F.when(days_left < 0, "expired")
    for days in C.EXPIRY_WARNING_DAYS:
        band = band.when(days_left <= days, f"within {days} days")
    return band.otherwise("valid")


def expiry_report(certificates: DataFrame, as_of: str) -> DataFrame:
    """Certificates per kind and expiry band. ``certificates`` has (kind, issued_at)."""
    validity = F.when(F.col("kind") == "host", C.HOST_CERT_DAYS).otherwise(C.USER_CERT_DAYS)
    expires = F.date_add(F.to_date("issued_at"), validity)
    left = F.datediff(expires, F.lit(as_of).cast("date"))
    return certificates.groupBy("kind", expiry_band(left).alias("band")).agg(
        F.count(F.lit(1)).alias("certificates"), F.min(left).alias("soonest_days")
    )


def alerts(audit: DataFrame, pattern: str = "(revoke|emergency|root)") -> DataFrame:
    """Lines that mention something worth an alert; works on a stream as well."""
    line = F.concat_ws(" | ", "op", "key", "user", "client")
    return audit.filter(line.rlike(pattern))
