"""Arriving file summaries as a stream, each id once however late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch import schemas
from tidewatch.session import settle, shared_dir
from tidewatch.sources.loads import ingest_dedup, split_loads
from tidewatch.streaming.store import Folders, Seen

REJECTED = f"{schemas.LOADS}, violations ARRAY<STRING>"


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/streams/{name}"


def read_load_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schemas.LOADS).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


class Intake:
    """Accepted loads, rejected loads with their reasons, and the ids that were ever accepted.

    Nothing is held in a streaming state and no watermark drops a file: ids lie in hash buckets behind a filter of fixed
    size (``Seen``), so a batch reads the filter and the buckets of ids that may be repeated. A batch that is run again
    replaces its rows and gives the same ones.
    """

    def __init__(self, spark: SparkSession, root: str, institutions: DataFrame, buckets: int = 64) -> None:
        self.spark, self.institutions = spark, institutions
        self.ids = Seen(spark, f"{root}/ids", ["institution", "external_id"], "institution STRING, external_id STRING", buckets)
        self.accepted, self.refused = Folders(spark, f"{root}/loads"), Folders(spark, f"{root}/rejected")

    def take(self, batch: DataFrame, batch_id: int, tidy: bool = True) -> DataFrame:
        """The loads of a batch that are valid, of known senders and new."""
        if tidy:
            self.ids.tidy(batch_id)
        good, bad = split_loads(batch)
        names = self.institutions.select("institution").distinct()
        unknown = good.join(names, "institution", "left_anti").withColumn("violations", F.array(F.lit("unknown_institution")))
        once = settle(ingest_dedup(good, self.institutions), "once")
        known = self.ids.find(once, before=batch_id).distinct()
        again = once.join(known, ["institution", "external_id"], "left_semi").withColumn("violations", F.array(F.lit("repeated_external_id")))
        fresh = once.join(known, ["institution", "external_id"], "left_anti")
        self.accepted.write(fresh, batch_id)
        columns = [*fresh.columns, "violations"]
        self.refused.write(bad.select(*columns).unionByName(unknown.select(*columns)).unionByName(again.select(*columns)), batch_id)
        stored = self.accepted.read([batch_id], schemas.LOADS).drop("batch_id")
        self.ids.add(stored.select("institution", "external_id"), batch_id)
        return stored

    def loads(self) -> DataFrame:
        return self.accepted.read(self.accepted.numbers(), schemas.LOADS)

    def rejected(self) -> DataFrame:
        return self.refused.read(self.refused.numbers(), REJECTED)


def stream_ingest(loads: DataFrame, intake: Intake, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Valid loads of known institutions, one per (institution, external_id), however late; the others go to ``rejected``."""

    def put(batch: DataFrame, batch_id: int) -> None:
        intake.take(batch, batch_id)

    writer = loads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet until the source has no more files, then stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
