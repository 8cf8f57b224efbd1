"""Briefs for analysts: runbook entries, facts behind an incident, impact sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch import fixed
from tidewatch.functions.scalar import money, num
from tidewatch.operators.evaluate import KEY

RECENT_DAYS, RECENT_ROWS = 30, 10


def runbook_table(spark: SparkSession) -> DataFrame:
    rows = [(code, causes, checks) for code, (causes, checks) in fixed.RUNBOOK.items()]
    return spark.createDataFrame(rows, "code STRING, causes ARRAY<STRING>, checks ARRAY<STRING>")


def impact_sentence(customers: Column, amount: Column) -> Column:
    some = F.coalesce(customers, F.lit(0.0)) != 0
    tail = F.when(F.coalesce(amount, F.lit(0.0)) != 0, F.concat(F.lit(" (≈"), money(amount), F.lit(")."))).otherwise(".")
    return F.when(some, F.concat(F.lit("Yaklaşık "), num(customers), F.lit(" müşterinin borç ödemesi etkilenebilir"), tail)).otherwise(
        "Doğrudan müşteri etkisi hesaplanmadı."
    )


def runbook_brief(incidents: DataFrame, findings: DataFrame, runbook: DataFrame) -> DataFrame:
    """(incident_id, summary, customer_impact, likely_causes, recommended_checks).

    The runbook is a fixed table of some twenty rows; it becomes one map value, so incidents are not
    shuffled for it. ``findings`` is long with ord, severity and message.
    """
    book = runbook.agg(F.map_from_entries(F.collect_list(F.struct("code", F.struct("causes", "checks")))))
    msgs = (
        findings.filter(F.col("severity") != "INFO")
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct("ord", "message"))).alias("m"))
        .select(*KEY, F.array_join(F.slice(F.col("m.message"), 1, 2), " ").alias("said"))
    )
    empty = F.array().cast("array<string>")

    def entries(field: str) -> Column:
        per_code = F.transform("codes", lambda c: F.coalesce(F.try_element_at("_book", c)[field], empty))
        return F.array_distinct(F.flatten(per_code))

    return (
        incidents.withColumn("_book", book.scalar())
        .join(msgs, KEY, "left")
        .select(
            "incident_id",
            F.coalesce(F.nullif("said", F.lit("")), F.col("title")).alias("summary"),
            impact_sentence(F.col("impact_customers"), F.col("impact_amount")).alias("customer_impact"),
            entries("causes").alias("likely_causes"),
            entries("checks").alias("recommended_checks"),
        )
    )


def tidy(v: Column) -> Column:
    """Whole numbers without decimals, others to 2 decimals, below 1 to 4."""
    whole = (v == F.floor(v)) & (F.abs(v) >= 1)
    return (
        F.when(whole, F.floor(v).cast("bigint").cast("string"))
        .when(F.abs(v) >= 1, F.bround(v, 2).cast("string"))
        .otherwise(F.bround(v, 4).cast("string"))
    )


def recent_deliveries(occ: DataFrame, days: int = RECENT_DAYS, n: int = RECENT_ROWS) -> DataFrame:
    """Adds recent: up to ``n`` newest earlier occurrences of the same slot within ``days`` days.

    A window over the slot's days serves every occurrence in one pass; no pairs are formed.
    """
    w = W.partitionBy("institution", "slot_key").orderBy(F.unix_date("business_date")).rangeBetween(-days, -1)
    rows = F.collect_list(F.struct("business_date", "status", "max_severity")).over(w)
    return occ.withColumn("recent", F.slice(F.reverse(rows), 1, n))


def brief_facts(incidents: DataFrame, occ: DataFrame, institutions: DataFrame) -> DataFrame:
    """(incident_id, facts): the facts a brief may use, as JSON with tidied numbers."""
    o = recent_deliveries(occ).select(*KEY, F.col("status").alias("occ_status"), "load_count", "total_amount", "recent")
    j = incidents.join(o, KEY, "left").join(institutions.select("institution", "sector", "tier"), "institution", "left")
    facts = F.to_json(
        F.struct(
            F.struct(
                F.col("incident_id").alias("number"),
                "title",
                "severity",
                "priority",
                "category",
                "codes",
                tidy(F.col("impact_customers")).alias("impact_customers"),
                tidy(F.col("impact_amount")).alias("impact_amount"),
            ).alias("incident"),
            F.when(F.col("institution").isNotNull(), F.struct(F.col("institution").alias("name"), "sector", "tier")).alias("institution"),
            F.when(
                F.col("occ_status").isNotNull(),
                F.struct(
                    F.col("slot_key").alias("slot"),
                    F.col("business_date"),
                    F.col("occ_status").alias("status"),
                    F.col("load_count").alias("file_count"),
                    tidy(F.col("total_amount")).alias("total_amount"),
                ),
            ).alias("delivery"),
            F.col("recent").alias("recent_deliveries"),
        )
    )
    return j.select("incident_id", facts.alias("facts"))
