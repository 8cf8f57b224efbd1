"""Numbers stated in texts, checked against known facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number formats, tried in this order at each position.
LONG_DECIMAL = r"(?<![\w.,])[-+]?\d+[.,]\d{4,}(?![.,]?\d)"
THOUSANDS = r"(?<![\w])[-+]?\d{1,3}(?:[.\s]\d{3})+(?:,\d+)?(?!\d)"
PLAIN = r"[-+]?\d+(?:[.,]\d+)?"
NUMBER = f"(?U)({LONG_DECIMAL}|{THOUSANDS}|{PLAIN})"
SMALL = 31
TOLERANCE, LARGE, LARGE_TOLERANCE = 0.015, 1000, 0.02


def _value(token: Column) -> Column:
    t = F.replace(token, F.lit(" "), F.lit(""))
    long_decimal = t.rlike(r"^[-+]?\d+[.,]\d{4,}$")
    grouped = t.rlike(r"^[-+]?\d{1,3}(?:\.\d{3})+(?:,\d+)?$")
    comma_only = t.contains(",") & ~t.contains(".")
    text = (
        F.when(long_decimal, F.translate(t, ",", "."))
        .when(grouped, F.translate(F.translate(t, ".", ""), ",", "."))
        .when(comma_only, F.translate(t, ",", "."))
        .otherwise(t)
    )
    return text.try_cast("double")


def numbers_in(text: Column) -> Column:
    """Every number a text states, in order."""
    tokens = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    return F.array_compact(F.transform(tokens, _value))


def is_close(a: Column, b: Column) -> Column:
    """Equal, or within tolerance of the fact or of the fact read as a percentage or a share."""

    def near(cand: Column) -> Column:
        return (cand != 0) & (F.abs(a - cand) / F.greatest(F.abs(cand), F.lit(1e-9)) <= TOLERANCE)

    big = (F.abs(a) >= LARGE) & (F.abs(a - b) <= LARGE_TOLERANCE * F.greatest(F.abs(a), F.abs(b)))
    return (a == b) | near(b) | near(b * 100) | near(b / 100) | big


def check_grounding(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, status, checked_numbers, unverified) for texts(id, text) and facts(id, numbers).

    The whole text is read; only the list shown is limited to 20 numbers, as in the report it feeds.
    """
    j = texts.withColumn("_stated", numbers_in(F.col("text"))).drop("text").join(facts, "id", "left")
    known = F.coalesce("numbers", F.array().cast("array<double>"))
    claims = F.filter("_stated", lambda n: F.abs(n) > SMALL)
    unknown = F.filter(F.array_distinct("_claims"), lambda n: ~F.exists("_known", lambda k: is_close(n, k)))
    return (
        j.withColumns({"_claims": claims, "_known": F.array_distinct(known)})
        .withColumn("_unknown", F.sort_array(unknown))
        .select(
            "id",
            F.when(F.size("_unknown") == 0, "GROUNDED").otherwise("UNVERIFIED_NUMBERS").alias("status"),
            F.size("_claims").alias("checked_numbers"),
            F.size("_unknown").alias("unverified_total"),
            F.slice("_unknown", 1, 20).alias("unverified"),
        )
    )
