"""Files of one delivery -> one row of metrics; repeated content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed

KEY = ["institution", "slot_key", "business_date"]


def metrics_struct(n: Column, amt: Column, cust: Column, zero: Column, neg: Column, dup: Column, files: Column, top: Column) -> Column:
    amount, some = amt.cast("double"), n > 0
    return F.struct(
        n.cast("double").alias("record_count"),
        amount.alias("total_amount"),
        cust.cast("double").alias("customer_count"),
        F.when(some, amount / n).otherwise(0.0).alias("avg_amount"),
        F.when(some, zero / n).otherwise(0.0).alias("zero_amount_ratio"),
        neg.cast("double").alias("negative_amount_count"),
        F.when(some, dup / n).otherwise(0.0).alias("duplicate_record_ratio"),
        files.cast("double").alias("file_count"),
        top.cast("double").alias("max_amount"),
    )


def aggregate_metrics(assigned: DataFrame) -> DataFrame:
    """Sums are taken in DECIMAL, so the result does not depend on the order of files."""
    return (
        assigned.filter(F.col("slot_key").isNotNull())
        .groupBy(*KEY)
        .agg(
            metrics_struct(
                F.sum("record_count"),
                F.sum("total_amount"),
                F.sum("customer_count"),
                F.sum("zero_amount_count"),
                F.sum("negative_amount_count"),
                F.sum("duplicate_record_count"),
                F.count("*"),
                F.max("max_amount"),
            ).alias("metrics"),
            F.min("received_at").alias("first_received_at"),
            F.count("*").alias("load_count"),
            F.min_by("version", "received_at").alias("first_version"),
            F.min_by("timezone", "received_at").alias("load_timezone"),
        )
    )


def first_seen(loads: DataFrame) -> DataFrame:
    """Earliest receipt per sender and content; a plain aggregation, so a hash repeated in a third of all files combines map-side."""
    return loads.groupBy("institution", "content_hash").agg(F.min("received_at").alias("first_seen_at"))


def seen_before(loads: DataFrame) -> DataFrame:
    """Loads whose content the same sender delivered strictly earlier.

    Only hashes that occur at more than one instant can match, so the join sees just those; their
    loads are salted because one hash may be a large share of all files.
    """
    salts = 32
    repeated = (
        loads.groupBy("institution", "content_hash")
        .agg(F.min("received_at").alias("first_seen_at"), F.max("received_at").alias("_last"))
        .filter("_last > first_seen_at")
        .select("institution", "content_hash", "first_seen_at", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    )
    return (
        loads.withColumn("_salt", F.pmod(F.xxhash64("load_id"), F.lit(salts)).cast("int"))
        .join(repeated, ["institution", "content_hash", "_salt"])
        .filter("received_at > first_seen_at")
        .drop("_salt")
    )


def repeated_content(assigned: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Per occurrence with repeated content: the first hash that repeats and the load that repeats it.

    Content repeats when the sender delivered it earlier, or when two files of the occurrence carry it.
    Loads are first combined per (occurrence, hash), so the join with ``first_seen`` runs on few rows.
    ``earlier`` is the ``first_seen`` of loads that are not in ``assigned``.
    """
    per_hash = (
        assigned.filter(F.col("slot_key").isNotNull())
        .groupBy(*KEY, "content_hash")
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct("received_at", "load_id")).alias("lo"),
            F.max(F.struct("received_at", "load_id")).alias("hi"),
        )
    )
    seen = first_seen(assigned)
    if earlier is not None:
        seen = seen.unionByName(earlier).groupBy("institution", "content_hash").agg(F.min("first_seen_at").alias("first_seen_at"))
    flagged = per_hash.join(seen, ["institution", "content_hash"]).filter(
        (F.col("n") > 1) | (F.col("first_seen_at") < F.col("lo.received_at"))
    )
    hit = F.when(F.col("first_seen_at") < F.col("lo.received_at"), F.col("lo")).otherwise(F.col("hi"))
    return (
        flagged.withColumn("hit", hit)
        .groupBy(*KEY)
        .agg(F.min(F.struct("hit.received_at", "hit.load_id", "content_hash")).alias("h"))
        .select(*KEY, F.col("h.load_id").alias("dup_load_id"), F.substring("h.content_hash", 1, 16).alias("dup_hash"))
    )


def build_occurrences(expected: DataFrame, assigned: DataFrame, candidates: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Expected deliveries and deliveries nobody expected, with metrics where files came.

    ``candidates`` serves files matched just across a contract change: their delivery takes its window
    from the version that matched it. ``earlier`` holds contents of loads before these (``repeated_content``).
    """
    return join_expected(expected, aggregate_metrics(assigned).join(repeated_content(assigned, earlier), KEY, "left"), candidates)


def join_expected(expected: DataFrame, got: DataFrame, candidates: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences from expected deliveries and what came, one row per delivery; ``keep`` names columns of the first file to stay."""
    exp = expected.select(*KEY, "window_start_utc", "deadline_utc", "timezone", "slot_label", "month_phase", "iso_weekday", F.lit(True).alias("expected"))
    occ = exp.join(got, KEY, "full_outer")
    if candidates is not None:
        cand = candidates.select(
            *KEY,
            F.col("version").alias("first_version"),
            *[F.col(c).alias(f"c_{c}") for c in ("window_start_utc", "deadline_utc", "timezone", "slot_label", "month_phase", "iso_weekday")],
        )
        occ = occ.join(cand, [*KEY, "first_version"], "left")
        for c in ("window_start_utc", "deadline_utc", "timezone", "slot_label", "month_phase", "iso_weekday"):
            occ = occ.withColumn(c, F.coalesce(c, f"c_{c}")).drop(f"c_{c}")
    return occ.withColumns(
        {
            "expected": F.col("deadline_utc").isNotNull(),
            "timezone": F.coalesce("timezone", "load_timezone"),
            "slot_label": F.coalesce("slot_label", F.lit(fixed.UNSCHEDULED_LABEL)),
            "load_count": F.coalesce("load_count", F.lit(0).cast("bigint")),
        }
    ).drop(*{"first_version", "load_timezone"}.difference(keep))
