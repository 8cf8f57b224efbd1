"""Can past decisions be trusted? Snapshots, re-runs, the audit chain and shadow models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.operators.evaluate import KEY, champion
from tidewatch.session import settle

ENGINE_VERSION = "engine-2.1.0"

# Columns of a learned occurrence that the judgement reads.
JUDGED = [
    *KEY,
    "slot_label",
    "expected",
    "window_start_utc",
    "deadline_utc",
    "timezone",
    "month_phase",
    "iso_weekday",
    "metrics",
    "first_received_at",
    "load_count",
    "dup_load_id",
    "dup_hash",
    "duplicate",
    "stale",
    "prev",
    "unit_reference",
    "unit_n",
    "unit_ratio",
    "unit_factor",
    "excluded",
    "regime_break",
    "arrival",
    "reference",
    "baselines",
    "quality",
    "learning",
    "limits",
    "watches",
]


def decision_summary(findings: Column) -> Column:
    """What must be reproducible: sorted (code, severity, metric)."""
    return F.array_sort(
        F.transform(findings, lambda f: F.struct(f["code"].alias("code"), f["severity"].alias("severity"), F.coalesce(f["metric"], F.lit("")).alias("metric")))
    )


def snapshot(judged: DataFrame) -> DataFrame:
    """(KEY, sha256, payload): the content-addressed inputs of each decision."""
    payload = F.to_json(F.struct(*JUDGED, F.col("judged_at").alias("now")))
    return judged.select(*KEY, payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))


def store_snapshots(snapshots: DataFrame) -> DataFrame:
    """Each payload once."""
    return snapshots.groupBy("sha256").agg(F.any_value("payload").alias("payload"))


def evaluations(judged: DataFrame, snapshots: DataFrame, trigger: str) -> DataFrame:
    """Append-only decision rows that point at their inputs."""
    return judged.select(
        *KEY, "status", decision_summary(F.col("findings")).alias("summary"), F.col("judged_at").alias("evaluated_at"), F.lit(trigger).alias("trigger"),
        F.lit(ENGINE_VERSION).alias("engine_version"),
    ).join(snapshots.select(*KEY, "sha256"), KEY, "left")


def evaluation_dossier(evals: DataFrame, stored: DataFrame) -> DataFrame:
    return evals.join(stored, "sha256", "left")


def verify_decisions(evals: DataFrame, stored: DataFrame, schema: str, n: int | None = None, seed: int = 0) -> DataFrame:
    """Re-judge stored inputs with the current engine and compare. ``schema`` is the payload's DDL.

    ``n`` takes a random sample for a spot check, as a sampling operator; without it all are verified.
    """
    from tidewatch.operators.evaluate import judge

    picked = evals.filter("sha256 is not null")
    if n is not None:
        picked = picked.orderBy(F.rand(seed)).limit(n)
    d = picked.select("sha256", F.col("status").alias("was_status"), F.col("summary").alias("was_summary"), "engine_version").join(stored, "sha256", "left")
    # The judgement is a chain of projections over the restored inputs; no shuffle is added.
    p = F.from_json("payload", schema)
    restored = d.withColumn("p", p).select("sha256", "payload", "was_status", "was_summary", "engine_version", "p.*")
    rerun = judge(restored, F.col("now"))
    same = (F.col("status") == F.col("was_status")) & (decision_summary(F.col("findings")) == F.col("was_summary"))
    return rerun.select(
        *KEY,
        "sha256",
        (F.sha2("payload", 256) == F.col("sha256")).alias("snapshot_integrity"),
        same.alias("reproduced"),
        F.col("engine_version").alias("recorded_engine"),
        F.lit(ENGINE_VERSION).alias("current_engine"),
    )


def verification_report(verified: DataFrame) -> DataFrame:
    ok = F.col("reproduced") & F.col("snapshot_integrity")
    return verified.agg(F.count("*").alias("checked"), F.count_if(ok).alias("reproduced"), F.count_if(~ok).alias("mismatches"))


# --- audit chain -----------------------------------------------------------------------------------------

AUDIT_FIELDS = ["action", "actor", "at", "details", "entity_id", "entity_type"]


def audit_body() -> Column:
    at = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.to_json(F.struct(*[at.alias("at") if c == "at" else F.col(c) for c in AUDIT_FIELDS]))


def row_hash(prev: Column, body: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(prev, F.lit("")), F.lit("|"), body), 256)


BLOCK = 4096  # ids per chain block
CHAIN = ["entity_type", "entity_id", "block"]


def verify_chains(audit: DataFrame) -> DataFrame:
    """Per chain: ok, rows_checked, first_broken_id, head.

    Each row is checked against its predecessor's stored hash, so rows are checked side by side. A chain
    has at most BLOCK rows by construction.
    """
    w = W.partitionBy(*CHAIN).orderBy("id")
    prev = F.lag("row_hash").over(w)
    good = F.col("prev_hash").eqNullSafe(F.col("_prev")) & (F.col("row_hash") == row_hash(F.col("_prev"), audit_body()))
    checked = audit.withColumns({"_prev": prev, "_pos": F.row_number().over(w)}).withColumn("_bad", ~F.coalesce(good, F.lit(False)))
    bad = F.struct("id", "_pos")
    out = checked.groupBy(*CHAIN).agg(
        F.min(F.when(F.col("_bad"), bad)).alias("b"), F.count("*").alias("n"), F.max_by("row_hash", "id").alias("last")
    )
    ok = F.col("b").isNull()
    return out.select(
        *CHAIN,
        ok.alias("ok"),
        F.when(ok, F.col("n")).otherwise(F.col("b._pos")).cast("bigint").alias("rows_checked"),
        F.col("b.id").alias("first_broken_id"),
        F.when(ok, F.col("last")).alias("head"),
    )


def verify_audit_chain(audit: DataFrame) -> DataFrame:
    """One row: ok, rows_checked, first_broken_id, head.

    Every row can be checked against its predecessor's stored hash, so no sequential pass is needed. The
    table is range-partitioned by id; inside a partition the predecessor comes from a window, and the
    first row of each partition gets the last hash of the one before from a table of partition ends.
    """
    parts = int(audit.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(audit.repartitionByRange(parts, "id").withColumn("_p", F.spark_partition_id()), "audit")
    w = W.partitionBy("_p").orderBy("id")
    ends = ranged.groupBy("_p").agg(F.max_by("row_hash", "id").alias("_end"))
    # One row per partition: the unpartitioned window below sees at most ``parts`` rows.
    starts = ends.select("_p", F.lag("_end").over(W.orderBy("_p")).alias("_carry"))
    inside = F.lag("row_hash").over(w)
    first = F.row_number().over(w) == 1
    checked = (
        ranged.withColumns({"_inside": inside, "_first": first})
        .join(F.broadcast(starts), "_p")  # at most ``parts`` rows
        .withColumn("_prev", F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_inside")))
    )
    good = F.col("prev_hash").eqNullSafe(F.col("_prev")) & (F.col("row_hash") == row_hash(F.col("_prev"), audit_body()))
    broken = F.min(F.when(~F.coalesce(good, F.lit(False)), F.col("id")))
    agg = checked.agg(broken.alias("first_broken_id"), F.count("*").alias("n"), F.max_by("row_hash", "id").alias("last"))
    upto = ranged.filter(F.col("id") <= agg.select("first_broken_id").scalar()).agg(F.count("*"))
    intact = F.col("first_broken_id").isNull()
    return agg.select(
        intact.alias("ok"),
        F.when(intact, F.col("n")).otherwise(upto.scalar()).alias("rows_checked"),
        "first_broken_id",
        F.when(intact, F.col("last")).alias("head"),
    )


def append_audit_chain(events: DataFrame) -> DataFrame:
    """Chains events per entity and block of ids: each row commits to the hash of the one before it.

    A hash chain is serial by nature. Cutting it at fixed id blocks bounds every group at BLOCK rows,
    even for an entity with a third of all events; blocks run side by side and ``audit_root`` commits to
    all of their heads.
    """
    blocked = events.withColumn("block", F.floor(F.col("id") / BLOCK))
    item = F.struct("id", *[c for c in AUDIT_FIELDS if c not in CHAIN], audit_body().alias("body"))
    grouped = blocked.groupBy(*CHAIN).agg(F.array_sort(F.collect_list(item)).alias("items"))
    hashes = F.aggregate(
        "items",
        F.array(F.lit(None).cast("string")),
        lambda acc, x: F.concat(acc, F.array(row_hash(F.element_at(acc, -1), x["body"]))),
    )
    linked = grouped.withColumn("h", hashes).select(*CHAIN, F.posexplode("items").alias("i", "x"), "h")
    return linked.select(
        F.col("x.id").alias("id"),
        *CHAIN,
        "x.at",
        "x.actor",
        "x.action",
        "x.details",
        F.get("h", F.col("i")).alias("prev_hash"),
        F.get("h", F.col("i") + 1).alias("row_hash"),
    )


def audit_root(chained: DataFrame) -> DataFrame:
    """One value over all chains: exact sums of 60-bit halves of each chain's head, so order does not matter."""
    heads = chained.groupBy(*CHAIN).agg(F.max_by("row_hash", "id").alias("head"))
    half = lambda at: F.sum(F.conv(F.substring("head", at, 15), 16, 10).cast("decimal(20,0)"))
    return heads.agg(F.count("*").alias("chains"), F.sha2(F.concat_ws("|", half(1).cast("string"), half(17).cast("string")), 256).alias("root"))


# --- shadow models -----------------------------------------------------------------------------------------


def run_challengers(learned: DataFrame, now: Column, names: list[str]) -> DataFrame:
    """(KEY, challenger, status, codes, max_severity, evaluated_at) of each challenger on the champion's inputs."""
    from tidewatch.operators.evaluate import ENGINES
    from tidewatch.operators.replay import alert_codes

    out = None
    for name in names:
        d = ENGINES[name](learned, now).select(
            *KEY,
            F.lit(name).alias("challenger"),
            "status",
            alert_codes(F.col("findings")).alias("codes"),
            "max_severity",
            F.col("judged_at").alias("evaluated_at"),
        )
        out = d if out is None else out.unionByName(d)
    return out


def run_champion(learned: DataFrame, now: Column) -> DataFrame:
    return champion(learned, now)


def shadow_rows(shadow: DataFrame, champion_codes: DataFrame, incidents: DataFrame, truths: DataFrame | None, since: Column) -> DataFrame:
    """One row per shadow result with the champion's codes, verdict flags and truth."""
    verdict = (
        incidents.filter("resolution is not null and business_date is not null")
        .groupBy(*KEY)
        .agg(
            F.bool_or(F.col("resolution") == "TRUE_POSITIVE").alias("confirmed"),
            F.bool_or(F.col("resolution").isin(fixed.NOISY_VERDICTS)).alias("false_alarm"),
        )
    )
    rows = (
        shadow.filter(F.col("evaluated_at") >= since)
        .join(champion_codes.select(*KEY, F.col("codes").alias("champ")), KEY)
        .join(verdict, KEY, "left")
    )
    if truths is None:
        rows = rows.withColumn("is_true", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(truths.select(*KEY).distinct().withColumn("is_true", F.lit(True)), KEY, "left").withColumn("is_true", F.coalesce("is_true", F.lit(False)))
    a, b = F.size("champ") > 0, F.size("codes") > 0
    return rows.withColumns(
        {
            "agreement": F.when(a & b, "both").when(a, "champion_only").when(b, "challenger_only").otherwise("neither"),
            "confirmed": F.coalesce("confirmed", F.lit(False)),
            "false_alarm": F.coalesce("false_alarm", F.lit(False)),
        }
    )


def shadow_report(rows: DataFrame) -> DataFrame:
    """Per challenger: agreement with the champion, verdicts and truths caught."""
    a, b, t = F.size("champ") > 0, F.size("codes") > 0, F.coalesce("is_true", F.lit(False))
    return rows.groupBy("challenger").agg(
        F.count("*").alias("evaluated"),
        *[F.count_if(F.col("agreement") == x).alias(f"agree_{x}") for x in ("both", "champion_only", "challenger_only", "neither")],
        F.count_if("confirmed").alias("confirmed_issues"),
        F.count_if(F.col("confirmed") & b).alias("confirmed_caught_by_challenger"),
        F.count_if("false_alarm").alias("false_alarms"),
        F.count_if(F.col("false_alarm") & b).alias("false_alarms_challenger_still_alerts"),
        F.count_if(b).alias("challenger_alerts"),
        F.count_if(b & t).alias("challenger_true"),
        F.count_if(a).alias("champion_alerts"),
        F.count_if(a & t).alias("champion_true"),
        F.count_if(t).alias("issues"),
        F.count_if(t & a).alias("champion_caught"),
        F.count_if(t & b).alias("challenger_caught"),
    )


def only_challenger(rows: DataFrame, n: int = 25) -> DataFrame:
    """The newest occurrences per challenger that only it alerts on."""
    extra = F.array_except("codes", "champ")
    w = W.partitionBy("challenger").orderBy(F.desc("business_date"), "institution", "slot_key")
    return (
        rows.filter(F.col("agreement") == "challenger_only")
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= n)
        .select("challenger", *KEY, F.when(F.size(extra) > 0, extra).otherwise(F.col("codes")).alias("codes"))
    )
