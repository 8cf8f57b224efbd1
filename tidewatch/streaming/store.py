"""Tables that micro-batches write and read: the latest row of a key, and which keys were ever seen.

Both write under the batch's number, so a batch that is run again replaces what it wrote, and both read a bounded
amount per batch however many batches there were.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Folders:
    """Numbered folders below a path, on whatever file system it lies."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._dir = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._dir.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Complete ones, ascending."""
        if not self._fs.exists(self._dir):
            return []
        out = []
        for s in self._fs.listStatus(self._dir):
            name = s.getPath().getName()
            if name.startswith("batch_id=") and self._fs.exists(self._at(f"{name}/_SUCCESS")):
                out.append(int(name.removeprefix("batch_id=")))
        return sorted(out)

    def _at(self, name: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._dir, name)

    def drop(self, number: int) -> None:
        self._fs.delete(self._at(f"batch_id={number}"), True)

    def write(self, df: DataFrame, number: int, order: str | None = None) -> None:
        if order is not None:  # files of close values, so that a filter skips the others
            df = df.repartitionByRange(order).sortWithinPartitions(order)
        df.write.mode("overwrite").parquet(f"{self.path}/batch_id={number}")

    def read(self, numbers: list[int], schema: str) -> DataFrame:
        full = f"{schema}, batch_id BIGINT"
        if not numbers:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", self.path).parquet(*[f"{self.path}/batch_id={n}" for n in numbers])


class Latest:
    """The latest row of each key.

    Batches append their rows; every ``fold`` batches the rows read so far become one base, and what it holds is
    removed. A read sees the base and fewer than 2 * ``fold`` batches, and of those the rows that ``where`` asks for; a base
    is sorted by ``order``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, fold: int = 20, order: str | None = None) -> None:
        self.spark, self.keys, self.schema, self.fold, self.order = spark, keys, schema, fold, order
        self.log, self.base = Folders(spark, f"{path}/log"), Folders(spark, f"{path}/base")

    def read(self, before: int | None = None, where: Column | None = None) -> DataFrame:
        """Rows as they were before a batch (so a batch that is run again does not see its own); ``where`` reaches the scans."""
        every = self.base.numbers()
        bases = [n for n in every if before is None or n < before]
        if every and not bases:
            raise ValueError(f"batches from {before} on are folded already")
        upto = bases[-1] if bases else -1
        logs = [n for n in self.log.numbers() if n > upto and (before is None or n < before)]
        parts = [self.base.read(bases[-1:], self.schema), self.log.read(logs, self.schema)]
        rows = reduce(DataFrame.unionByName, [p if where is None else p.filter(where) for p in parts])
        value = F.struct(*[c for c in rows.columns if c not in (*self.keys, "batch_id")])
        return rows.groupBy(*self.keys).agg(F.max_by(value, "batch_id").alias("r")).select(*self.keys, "r.*")

    def write(self, df: DataFrame, batch_id: int) -> None:
        self.log.write(df, batch_id)

    def tidy(self, batch_id: int) -> None:
        """To be called as a batch begins: folds what batches before ``batch_id`` wrote, if they are many. None of them may be run again."""
        bases = self.base.numbers()
        logs = [n for n in self.log.numbers() if n < batch_id]
        since = [n for n in logs if not bases or n > bases[-1]]
        if len(since) < self.fold:
            return
        upto = since[-1]
        self.base.write(self.read(upto + 1), upto, self.order)
        for n in logs:
            self.log.drop(n)
        for n in bases:
            self.base.drop(n)


class Seen:
    """Rows by key, found without reading those of other keys.

    Rows lie in buckets by a hash of their key. A filter of fixed size, one 64-bit word per (bucket, place) with three bits
    set for each key, says which keys can be there; only the buckets of such keys are read, and a join decides.
    When the filter fills up more buckets are read, and results stay the same.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64, words: int = 1 << 14, fold: int = 20) -> None:
        self.spark, self.path, self.keys, self.schema, self.buckets, self.words = spark, path, keys, schema, buckets, words
        self.filter = Latest(spark, f"{path}/filter", ["bucket", "word", "batch"], "bucket INT, word INT, batch BIGINT, bits BIGINT", fold)

    def _placed(self, df: DataFrame) -> DataFrame:
        h = F.xxhash64(*self.keys)
        bit = lambda k: F.expr(f"shiftleft(1L, cast(pmod(shiftright(_h, {k}), 64) as int))")
        placed = df.withColumn("_h", h).withColumns({"bucket": F.pmod("_h", F.lit(self.buckets)).cast("int"), "word": F.pmod(F.shiftright("_h", 20), F.lit(self.words)).cast("int")})
        return placed.withColumn("_bits", bit(8).bitwiseOR(bit(38)).bitwiseOR(bit(48)))

    def _words(self, before: int | None) -> DataFrame:
        return self.filter.read(before).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))

    def suspects(self, df: DataFrame, before: int | None = None) -> DataFrame:
        """Rows of ``df`` whose key can have been seen, with their bucket."""
        met = self._placed(df).join(self._words(before), ["bucket", "word"])
        return met.filter(F.col("bits").bitwiseAND(F.col("_bits")) == F.col("_bits")).drop("_h", "_bits", "bits", "word")

    def find(self, df: DataFrame, before: int | None = None) -> DataFrame:
        """Stored rows, of batches before one, whose key occurs in ``df``."""
        asked = self.suspects(df.select(*self.keys), before).distinct()
        touched = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())
        full = f"{self.schema}, bucket INT, batch_id BIGINT"
        if not touched:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(full).option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/bucket={b}" for b in touched])
        rows = rows if before is None else rows.filter(F.col("batch_id") < before)
        return rows.join(asked.select(*self.keys, "bucket"), [*self.keys, "bucket"], "left_semi").drop("bucket", "batch_id")

    def add(self, df: DataFrame, batch_id: int) -> None:
        """Rows first: a filter that knows of rows not yet written costs a read, the reverse would lose them."""
        placed = self._placed(df).withColumn("batch_id", F.lit(batch_id).cast("long"))
        rows = placed.drop("_h", "word", "_bits").repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(f"{self.path}/rows")
        bits = placed.groupBy("bucket", "word").agg(F.bit_or("_bits").alias("bits"))
        self.filter.write(bits.select("bucket", "word", F.lit(batch_id).cast("long").alias("batch"), "bits"), batch_id)

    def tidy(self, batch_id: int) -> None:
        """Words of earlier batches become one word per place."""
        bases, logs = self.filter.base.numbers(), [n for n in self.filter.log.numbers() if n < batch_id]
        if len(logs) < self.filter.fold:
            return
        merged = self._words(logs[-1] + 1).select("bucket", "word", F.lit(-1).cast("long").alias("batch"), "bits")
        self.filter.base.write(merged, logs[-1])
        for n in logs:
            self.filter.log.drop(n)
        for n in bases:
            self.filter.base.drop(n)


class Numbers:
    """One ascending number for each batch of several queries that write the same tables; the same one when a batch is run again."""

    def __init__(self, spark: SparkSession, path: str, kept: int = 200) -> None:
        self._dir = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._dir.getFileSystem(spark._jsc.hadoopConfiguration())
        self._spark, self._kept = spark, kept

    def _known(self) -> dict[tuple[str, int], int]:
        known = {}
        if self._fs.exists(self._dir):
            for s in self._fs.listStatus(self._dir):
                name, batch, number = s.getPath().getName().split("-")
                known[name, int(batch)] = int(number)
        return known

    def settled(self, *sources: str) -> int:
        """Numbers below this belong to batches that none of the sources runs again: each repeats its newest one at most."""
        known = self._known()
        return min((max(n for (name, _), n in known.items() if name == source) for source in sources if any(name == source for name, _ in known)), default=0)

    def of(self, source: str, batch_id: int) -> int:
        known = self._known()
        if (source, batch_id) in known:
            return known[source, batch_id]
        number = max(known.values(), default=-1) + 1
        self._fs.create(self._path(source, batch_id, number), False).close()
        for (name, batch), old in known.items():
            if old < number - self._kept and any(n == name and o > old for (n, _), o in known.items()):
                self._fs.delete(self._path(name, batch, old), False)
        return number

    def _path(self, source: str, batch_id: int, number: int) -> object:
        return self._spark._jvm.org.apache.hadoop.fs.Path(self._dir, f"{source}-{batch_id}-{number}")
