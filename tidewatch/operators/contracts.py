"""Contract tables: validity, validation, versions of the format, hashes and differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch import fixed, schemas

CURRENT_SCHEMA_VERSION = 1


def contract_validity(contracts: DataFrame) -> DataFrame:
    """APPROVED versions with [valid_from, valid_to); the highest version wins a shared start date."""
    rest = [c for c in contracts.columns if c not in ("institution", "effective_from")]
    winners = (
        contracts.filter(F.col("status") == "APPROVED")
        .groupBy("institution", "effective_from")
        .agg(F.max_by(F.struct(*rest), "version").alias("r"))
        .select("institution", "effective_from", "r.*")
    )
    w = W.partitionBy("institution").orderBy("effective_from")
    return winners.withColumn("valid_from", F.col("effective_from")).withColumn("valid_to", F.lead("effective_from").over(w))


def effective_contract(keys: DataFrame, contracts: DataFrame, on: str = "on") -> DataFrame:
    """As-of join: the contract in force on a date, null columns where there is none."""
    spec = contract_validity(contracts).drop("effective_from", "status")
    k, c = keys.alias("k"), spec.alias("c")
    cond = (
        (F.col("k.institution") == F.col("c.institution"))
        & (F.col(f"k.{on}") >= F.col("c.valid_from"))
        & (F.col("c.valid_to").isNull() | (F.col(f"k.{on}") < F.col("c.valid_to")))
    )
    return k.join(c, cond, "left").select("k.*", *[F.col(f"c.{x}") for x in spec.columns if x != "institution"])


def pending_approvals(contracts: DataFrame, today: Column) -> DataFrame:
    """PENDING versions with the version in force beside them."""
    pending = contracts.filter(F.col("status") == "PENDING").select(
        "institution", F.col("version").alias("pending_version"), F.col("effective_from").alias("pending_from"), today.alias("on")
    )
    cur = effective_contract(pending, contracts)
    return cur.select("institution", "pending_version", "pending_from", F.col("version").alias("current_version"))


def validate_contracts(contracts: DataFrame) -> DataFrame:
    """(institution, version, path, violation): one row per broken rule."""
    key = F.col("slots")
    empty_int = F.array().cast("array<int>")

    def rule(bad: Column, name: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(name))

    def slot_rules(s: Column) -> Column:
        daily = s["cadence"].isin("BUSINESS_DAYS", "EVERY_DAY")
        wd, md = s["weekdays"], s["month_days"]
        last = F.coalesce(s["last_business_day"], F.lit(False))
        return F.array(
            rule(~s["key"].rlike("^[a-z0-9][a-z0-9_-]{0,47}$") & (s["key"] != fixed.UNSCHEDULED_SLOT), "slot_key_pattern"),
            rule(s["key"] == fixed.UNSCHEDULED_SLOT, "slot_key_reserved"),
            rule(~F.length(s["label"]).between(1, 120), "slot_label_length"),
            rule(~s["cadence"].isin("BUSINESS_DAYS", "EVERY_DAY", "WEEKLY", "MONTHLY"), "cadence_unknown"),
            rule(wd.isNotNull() & ((F.size(wd) == 0) | F.exists(wd, lambda d: (d < 1) | (d > 7))), "weekdays_range"),
            rule(md.isNotNull() & ((F.size(md) == 0) | F.exists(md, lambda d: (d < 1) | (d > 31))), "month_days_range"),
            rule((s["cadence"] == "WEEKLY") & (F.size(F.coalesce(wd, empty_int)) == 0), "weekly_needs_weekdays"),
            rule((s["cadence"] == "MONTHLY") & (F.size(F.coalesce(md, empty_int)) == 0) & ~last, "monthly_needs_days"),
            rule(daily & ((F.size(F.coalesce(wd, empty_int)) > 0) | (F.size(F.coalesce(md, empty_int)) > 0)), "daily_takes_no_days"),
            rule(s["deadline_min"] <= s["window_start_min"], "deadline_after_window"),
            rule(~s["grace_minutes"].between(0, 240), "grace_range"),
        )

    def limit_rules(x: Column) -> Column:
        return F.array(
            rule(~x["id"].rlike("^[a-z0-9][a-z0-9_-]{0,47}$"), "limit_id_pattern"),
            rule(x["min"].isNull() & x["max"].isNull(), "limit_needs_bound"),
            rule(x["min"] > x["max"], "limit_min_over_max"),
            rule(~x["metric"].isin(fixed.LIMITABLE), "limit_metric_unknown"),
            rule(~x["severity"].isin(fixed.ALERT_SEVERITIES), "limit_severity"),
        )

    def tagged(prefix: str, items: Column, name: str, rules) -> Column:  # noqa: ANN001
        per_item = F.transform(
            F.coalesce(items, F.array()),
            lambda x: F.transform(
                F.array_compact(rules(x)),
                lambda v: F.struct(F.concat(F.lit(prefix + "["), x[name], F.lit("]")).alias("path"), v.alias("violation")),
            ),
        )
        return F.flatten(per_item)

    def repeated(items: Column, name: str) -> Column:
        names = F.transform(items, lambda x: x[name])
        return F.size(F.array_distinct(names)) < F.size(names)

    q, learn = F.col("quality"), F.col("learning")
    whole = F.transform(
        F.array_compact(
            F.array(
                rule(F.size(F.coalesce(key, F.array())) == 0, "slots_empty"),
                rule(repeated(key, "key"), "slot_keys_unique"),
                rule(repeated(F.col("metrics"), "metric"), "metrics_unique"),
                rule(repeated(F.col("limits"), "id"), "limit_ids_unique"),
                rule(~q["max_zero_amount_ratio"].between(0, 1), "zero_ratio_range"),
                rule(~q["max_duplicate_record_ratio"].between(0, 1), "duplicate_ratio_range"),
                rule(~q["unexpected_delivery"].isin("IGNORE", "INFO", "WARNING"), "unexpected_policy"),
                rule(~learn["lookback_days"].between(30, 730), "lookback_range"),
                rule(~learn["min_history"].between(4, 200), "min_history_range"),
            )
        ),
        lambda v: F.struct(F.lit("").alias("path"), v.alias("violation")),
    )
    watch = tagged(
        "metrics",
        F.col("metrics"),
        "metric",
        lambda m: F.array(
            rule(~m["metric"].isin(fixed.WATCHABLE), "metric_unknown"),
            rule(~m["sensitivity"].isin("LOW", "MEDIUM", "HIGH"), "sensitivity_unknown"),
            rule(~m["direction"].isin("BOTH", "LOW_ONLY", "HIGH_ONLY"), "direction_unknown"),
        ),
    )
    found = F.concat(whole, tagged("slots", key, "key", slot_rules), watch, tagged("limits", F.col("limits"), "id", limit_rules))
    return contracts.select("institution", "version", F.explode(found).alias("v")).select("institution", "version", "v.path", "v.violation")


SPEC_JSON = f"""
  schema_version INT, timezone STRING, calendar STRING, slots ARRAY<{schemas.SLOT}>, deliveries ARRAY<{schemas.SLOT}>,
  metrics ARRAY<{schemas.WATCH}>, limits ARRAY<{schemas.LIMIT}>, quality {schemas.QUALITY}, learning {schemas.LEARNING}
"""

# One step per stored format version: old column set -> next one. Stored JSON itself is never rewritten.
UPCASTERS = {
    0: lambda df: df.withColumn(
        "slots", F.when(F.col("schema_version") == 0, F.coalesce("slots", "deliveries")).otherwise(F.col("slots"))
    ).withColumn("schema_version", F.greatest("schema_version", F.lit(1)))
}


def upcast_contracts(raw: DataFrame, payload: str = "spec_json") -> tuple[DataFrame, DataFrame]:
    """Stored JSON of any known format to the current columns; newer or unreadable rows go to errors."""
    p = raw.withColumn("p", F.from_json(payload, SPEC_JSON, {"mode": "PERMISSIVE"})).withColumn(
        "_v", F.when(F.col("p").isNotNull(), F.coalesce("p.schema_version", F.lit(0)))
    )
    bad = F.col("_v").isNull() | (F.col("_v") > CURRENT_SCHEMA_VERSION)
    errors = p.filter(bad).select(
        "institution",
        "version",
        F.when(F.col("_v").isNull(), "unreadable").otherwise(F.format_string("schema_version %d is newer than %d", F.col("_v"), F.lit(CURRENT_SCHEMA_VERSION))).alias("error"),
    )
    good = p.filter(~bad).drop("p").withColumn("p", F.from_json(payload, SPEC_JSON)).select(*[c for c in raw.columns if c != payload], "_v", "p.*")
    good = good.withColumn("schema_version", F.col("_v")).drop("_v")
    for step in range(CURRENT_SCHEMA_VERSION):
        good = UPCASTERS[step](good)
    good = good.drop("deliveries").withColumns(
        {
            "timezone": F.coalesce("timezone", F.lit(fixed.DEFAULT_TIMEZONE)),
            "calendar": F.coalesce("calendar", F.lit("TR")),
            "quality": F.coalesce("quality", F.expr(schemas.DEFAULT_QUALITY_SQL)),
            "learning": F.coalesce("learning", F.expr(schemas.DEFAULT_LEARNING_SQL)),
        }
    )
    return good, errors


# Alphabetical field order at every level makes the JSON canonical.
CANONICAL = {
    "calendar": None,
    "learning": ["lookback_days", "min_history"],
    "limits": ["id", "max", "metric", "min", "note", "severity"],
    "metrics": ["direction", "metric", "sensitivity"],
    "quality": [
        "detect_duplicate_file",
        "detect_stale_data",
        "detect_unit_scale",
        "forbid_negative_amounts",
        "max_duplicate_record_ratio",
        "max_zero_amount_ratio",
        "unexpected_delivery",
    ],
    "slots": [
        "cadence",
        "deadline_min",
        "grace_minutes",
        "holiday_shift",
        "key",
        "label",
        "last_business_day",
        "month_days",
        "weekdays",
        "window_start_min",
    ],
    "timezone": None,
}


def canonical_spec() -> Column:
    def field(name: str, sub: list[str] | None) -> Column:
        c = F.col(name)
        if sub is None:
            return c
        if name in ("slots", "metrics", "limits"):
            return F.transform(c, lambda x: F.struct(*[x[s].alias(s) for s in sub])).alias(name)
        return F.struct(*[c[s].alias(s) for s in sub]).alias(name)

    return F.to_json(F.struct(*[field(n, sub) for n, sub in CANONICAL.items()]))


def with_spec_hash(contracts: DataFrame) -> DataFrame:
    return contracts.withColumn("spec_hash", F.sha2(canonical_spec(), 256))


def flatten_spec(contracts: DataFrame) -> DataFrame:
    """(institution, version, path, value): one row per leaf, list items named by key, id or metric."""

    def leaf(path: Column, v: Column) -> Column:
        return F.struct(path.alias("path"), F.to_json(F.array(v.cast("string"))).alias("value"))

    def item_leaves(name: str, sub: list[str], ident: str) -> Callable[[Column], Column]:
        def leaves(x: Column) -> Column:
            at = F.concat(F.lit(name + "["), x[ident], F.lit("]."))
            text = {s: F.concat_ws(",", x[s].cast("array<string>")) if s in ("month_days", "weekdays") else x[s] for s in sub}
            return F.array(*[leaf(F.concat(at, F.lit(s)), text[s]) for s in sub])

        return leaves

    parts = [F.array(leaf(F.lit("calendar"), F.col("calendar")), leaf(F.lit("timezone"), F.col("timezone")))]
    for name, sub in CANONICAL.items():
        if sub is None:
            continue
        if name in ("learning", "quality"):
            parts.append(F.array(*[leaf(F.lit(f"{name}.{s}"), F.col(name)[s]) for s in sub]))
            continue
        ident = {"slots": "key", "metrics": "metric", "limits": "id"}[name]

        parts.append(F.flatten(F.transform(F.coalesce(F.col(name), F.array()), item_leaves(name, sub, ident))))
    return contracts.select("institution", "version", F.explode(F.concat(*parts)).alias("l")).select(
        "institution", "version", "l.path", "l.value"
    )


def spec_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed leaves between two contract tables, joined on institution and path."""
    a = flatten_spec(before).select("institution", "path", F.col("value").alias("before"))
    b = flatten_spec(after).select("institution", "path", F.col("value").alias("after"))
    return a.join(b, ["institution", "path"], "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
