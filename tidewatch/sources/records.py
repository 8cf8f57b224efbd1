"""Raw debt records to one summary row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _joined(*values: Column) -> Column:
    """One text per tuple of values: separators inside values are escaped, and null differs from every text."""
    escaped = [F.regexp_replace(v.cast("string"), r"([\\\\|])", r"\\\\$1") for v in values]
    return F.concat_ws("|", *[F.coalesce(e, F.lit("\\N")) for e in escaped])


def summarize_records(
    records: DataFrame,
    keys: list[str],
    amount: str,
    customer: str,
    record_key: list[str],
    row_hash: str | None = None,
) -> DataFrame:
    """Counts, exact sums and an order-free content hash per file.

    A first pass groups by (file, customer, record key): a file that holds a third of all records is
    spread over every task there, and the later passes combine partial sums. Distinct customers and
    distinct record keys are counted on the smaller rows. Where the customer is the record key, few records
    share a group and the records themselves are shorter than partial sums: they travel once, to their (file,
    customer), where one of each is marked; files are then summed and their marks counted on the map side.
    """
    amt = F.col(amount).cast("decimal(20,2)")
    text = _joined(*[F.col(c) for c in [customer, *record_key]], amt)
    digest = F.md5((F.col(row_hash) if row_hash else text).cast("binary"))
    half = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")
    if record_key == [customer]:
        group = list(dict.fromkeys([*keys, customer]))
        same = W.partitionBy(*group).orderBy(customer)
        short = records.select(*list(dict.fromkeys([*group, amount, *([row_hash] if row_hash else [])])))
        marked = short.repartition(*group).withColumn("_first", F.row_number().over(same) == 1).withColumns({"_amt": amt, "_h1": half(1), "_h2": half(17)})
        files = marked.groupBy(*keys).agg(
            F.count("*").alias("record_count"),
            F.sum("_amt").cast("decimal(20,2)").alias("total_amount"),
            F.count_if(F.col("_first") & F.col(customer).isNotNull()).alias("customer_count"),
            F.count_if(F.col("_amt") == 0).alias("zero_amount_count"),
            F.count_if(F.col("_amt") < 0).alias("negative_amount_count"),
            F.max("_amt").cast("decimal(20,2)").alias("max_amount"),
            F.sum("_h1").alias("_h1"),
            F.sum("_h2").alias("_h2"),
            F.count_if("_first").alias("_distinct"),
        )
        return _described(files, keys)
    rec = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(record_key)])
    pre = (
        records.withColumns({"_amt": amt, "_rec": rec, "_h1": half(1), "_h2": half(17)})
        .groupBy(*keys, F.col(customer).alias("_cust"), "_rec")
        .agg(
            F.count("*").alias("n"),
            F.sum("_amt").alias("s"),
            F.count_if(F.col("_amt") == 0).alias("z"),
            F.count_if(F.col("_amt") < 0).alias("g"),
            F.max("_amt").alias("m"),
            F.sum("_h1").alias("h1"),
            F.sum("_h2").alias("h2"),
        )
    )
    sums = {
        "record_count": F.sum("n"),
        "total_amount": F.sum("s").cast("decimal(20,2)"),
        "zero_amount_count": F.sum("z"),
        "negative_amount_count": F.sum("g"),
        "max_amount": F.max("m").cast("decimal(20,2)"),
        "_h1": F.sum("h1"),
        "_h2": F.sum("h2"),
    }
    if customer in record_key:
        # A record key then belongs to one customer, so both distinct counts are plain counts of groups.
        per_customer = pre.groupBy(*keys, "_cust").agg(
            *[f(c).alias(c) for c, f in (("n", F.sum), ("s", F.sum), ("z", F.sum), ("g", F.sum), ("m", F.max), ("h1", F.sum), ("h2", F.sum))],
            F.count("*").alias("r"),
        )
        files = per_customer.groupBy(*keys).agg(
            *[c.alias(n) for n, c in sums.items()], F.count("_cust").alias("customer_count"), F.sum("r").alias("_distinct")
        )
    else:
        files = pre.groupBy(*keys).agg(
            *[c.alias(n) for n, c in sums.items()], F.count_distinct("_cust").alias("customer_count"), F.count_distinct("_rec").alias("_distinct")
        )
    return _described(files, keys)


def _described(files: DataFrame, keys: list[str]) -> DataFrame:
    digest_all = F.concat_ws("|", F.col("record_count").cast("string"), F.col("_h1").cast("string"), F.col("_h2").cast("string"))
    return files.select(
        *keys,
        "record_count",
        "total_amount",
        "customer_count",
        "zero_amount_count",
        "negative_amount_count",
        (F.col("record_count") - F.col("_distinct")).alias("duplicate_record_count"),
        "max_amount",
        F.md5(digest_all.cast("binary")).alias("content_hash"),
    )
