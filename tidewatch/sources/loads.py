"""Intake of file summaries and the append-only result tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schemas


def _violations() -> Column:
    def breach(name: str, bad: Column) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(name))

    checks = [
        breach("institution", (F.length("institution") < 1) | (F.length("institution") > 32)),
        breach("external_id", F.length("external_id") > 128),
        breach("received_at", F.col("received_at").isNull()),
        breach("content_hash", ~F.length("content_hash").between(8, 128)),
        breach("total_amount", F.col("total_amount").isNull()),
        breach("source", ~F.coalesce("source", F.lit("API")).isin("API", "SFTP", "SIM")),
        breach("file_name", F.coalesce(F.length("file_name") > 255, F.lit(False))),
        breach("slot_hint", F.coalesce(F.length("slot_hint") > 48, F.lit(False))),
        breach("record_count", F.col("record_count") < 0),
        breach("customer_count", F.col("customer_count") < 0),
    ]
    checks += [
        breach(c, F.coalesce(F.col(c), F.lit(0)) < 0)
        for c in ("zero_amount_count", "negative_amount_count", "duplicate_record_count")
    ]
    return F.array_compact(F.array(*checks))


def split_loads(loads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with defaults filled, and rejected rows with the names of the broken fields."""
    checked = loads.withColumn("violations", _violations())
    zero = F.lit(0).cast("bigint")
    good = (
        checked.filter(F.size("violations") == 0)
        .drop("violations")
        .withColumns(
            {
                c: F.coalesce(F.col(c), zero)
                for c in ("zero_amount_count", "negative_amount_count", "duplicate_record_count")
            }
        )
        .withColumn("source", F.coalesce("source", F.lit("API")))
    )
    return good, checked.filter(F.size("violations") > 0)


def read_loads(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    reader = spark.read.schema(schemas.LOADS).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return split_loads(reader.load(path))


def ingest_dedup(loads: DataFrame, institutions: DataFrame) -> DataFrame:
    """One row per (institution, external_id), the first ingested; unknown institutions dropped.

    ``min_by`` combines on the map side, so a sender that repeats one id millions of times does not
    travel in full; the struct's load_id breaks ties the same way on every run.
    """
    known = loads.join(institutions.select("institution").distinct(), "institution", "left_semi")
    row = F.struct(*[c for c in loads.columns if c not in ("institution", "external_id")])
    return (
        known.groupBy("institution", "external_id")
        .agg(F.min_by(row, F.struct("ingested_at", "load_id")).alias("r"))
        .select("institution", "external_id", "r.*")
        .select(*loads.columns)
    )


def load_facts(loads: DataFrame, since: datetime, institution: str | None = None) -> DataFrame:
    """Loads received since an instant; both filters reach the Parquet scan."""
    out = loads.filter(F.col("received_at") >= F.lit(since))
    return out if institution is None else out.filter(F.col("institution") == institution)


KEY = ["institution", "slot_key", "business_date"]


def new_decisions(evaluated: DataFrame, previous: DataFrame, trigger: str) -> DataFrame:
    """Decisions to append: every one, except that a deadline sweep adds only changed ones.

    ``evaluated`` and ``previous`` carry KEY, status, findings_json, metrics_json, evaluated_at.
    """
    body = ["status", "findings_json", "metrics_json"]
    last = previous.groupBy(*KEY).agg(F.max_by(F.struct(*body), F.struct("evaluated_at", *body)).alias("last"))
    out = evaluated.withColumn("trigger", F.lit(trigger))
    if trigger != "DEADLINE_SWEEP":
        return out
    same = F.struct(*body).eqNullSafe(F.col("last"))
    return out.join(last, KEY, "left").filter(~same).drop("last")


def write_decisions(decisions: DataFrame, path: str) -> None:
    decisions.write.mode("append").partitionBy("business_date").parquet(path)


def upsert_occurrences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-if-absent, then update: a new row sets all columns it has, so it can also clear a value."""
    values = [c for c in old.columns if c not in KEY]
    joined = old.alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), KEY, "full_outer")

    def value(c: str) -> Column:
        return F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")

    return joined.select(*KEY, *[value(c).alias(c) for c in values])


def overwrite_days(df: DataFrame, path: str) -> None:
    """Replace only the business dates present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("business_date").parquet(path)


def upsert_shadow(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The latest result per occurrence and challenger."""
    cols = [c for c in stored.columns if c not in (*KEY, "challenger")]
    # of equal times a new result wins over the stored one
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.select(*stored.columns).withColumn("__new", F.lit(1)))
    rest = [c for c in cols if c != "evaluated_at"]
    return (
        both.groupBy(*KEY, "challenger")
        .agg(F.max_by(F.struct(*cols), F.struct("evaluated_at", "__new", *rest)).alias("r"))
        .select(*KEY, "challenger", "r.*")
    )


def materialize(expected: DataFrame, existing: DataFrame, institutions: DataFrame, day: date) -> DataFrame:
    """PENDING occurrences of one day that are not stored yet, for active institutions."""
    active = institutions.filter("active").select("institution")
    return (
        expected.filter(F.col("business_date") == F.lit(day))
        .join(active, "institution", "left_semi")
        .join(existing.select(*KEY), KEY, "left_anti")
        .select(*KEY, "window_start_utc", "deadline_utc", F.lit(True).alias("expected"), F.lit("PENDING").alias("status"))
    )
