"""Holiday table: yearly and movable holidays, one row per date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import fixed


def fixed_holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.FIXED_HOLIDAYS, "month INT, dom INT, name STRING, is_half_day BOOLEAN")


def movable_holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.MOVABLE_HOLIDAYS, "first_day DATE, days INT, name STRING")


def build_holidays(yearly: DataFrame, movable: DataFrame, years: DataFrame, code: str = "TR") -> DataFrame:
    """(calendar, day, name, is_half_day). ``years`` has one INT column ``year``.

    Names of holidays on one date are joined with " / " in listing order (yearly before movable);
    a full day wins over a half day.
    """
    tagged = yearly.withColumn("ord", F.col("month") * 100 + F.col("dom"))
    # Every yearly holiday occurs in every year: the list is one value, no join is needed.
    listed = tagged.agg(F.array_sort(F.collect_list(F.struct("ord", "month", "dom", "name", "is_half_day"))).alias("hs"))
    y = (
        years.withColumn("hs", listed.scalar())
        .select("year", F.explode("hs").alias("h"))
        .select(F.make_date("year", "h.month", "h.dom").alias("day"), "h.ord", "h.name", "h.is_half_day")
    )
    m = (
        movable.join(years, F.year("first_day") == F.col("year"), "left_semi")
        .select("name", "days", "first_day", F.explode(F.sequence(F.lit(0), F.col("days"))).alias("i"))
        .select(
            F.date_add("first_day", F.col("i") - 1).alias("day"),
            (F.lit(10_000) + F.unix_date("first_day")).alias("ord"),
            F.when(F.col("i") == 0, F.concat("name", F.lit(" arifesi")))
            .otherwise(F.concat("name", F.lit(" "), F.col("i").cast("string"), F.lit(". gün")))
            .alias("name"),
            (F.col("i") == 0).alias("is_half_day"),
        )
    )
    return (
        y.unionByName(m)
        .groupBy("day")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), " / ").alias("name"),
            F.bool_and("is_half_day").alias("is_half_day"),
        )
        .select(F.lit(code).alias("calendar"), "day", "name", "is_half_day")
    )
