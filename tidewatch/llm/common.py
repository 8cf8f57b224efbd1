"""Helpers of the operators: Arrow maps, tables, bounded bit sets of keys."""

from __future__ import annotations

import ctypes
import functools
import sys
import types
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents in one Arrow batch, so that a batch of very long texts still fits beside a task's other memory.
BATCH_ROWS = 500
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): the two columns the text operators read; null texts stay null."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with small batches: few rows, and few bytes unless one row is large.

    Workers are used again and several may idle beside a busy one, so each gives its free memory back at the end.
    """

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo: list[pa.RecordBatch] = []
        for batch in batches:
            todo.append(batch)
            while todo:
                b = todo.pop()
                if b.nbytes > BATCH_BYTES and b.num_rows > 1:
                    half = b.num_rows // 2
                    todo += [b.slice(half), b.slice(0, half)]
                else:
                    yield b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(small(batches))
        give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns the worker's free memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, for results that depend on their key alone.

    Tasks come by value, so their modules' globals are new in each; a worker that serves many tasks keeps this.
    """
    holder = sys.modules.setdefault("_tidewatch_process_cache", types.ModuleType("_tidewatch_process_cache"))
    return holder.__dict__.setdefault(name, {})


def unknown(keys: set, held: dict, limit: int) -> set:
    """The keys that ``held["known"]`` lacks; of more entries than ``limit`` it first forgets some."""
    if len(held["known"]) > limit:
        forget(held, limit // 2)
    there = keys & held["known"].keys()
    held["again"] |= there
    return keys - there


def forget(held: dict, keep: int) -> None:
    """Leaves at most ``keep`` entries of ``held["known"]``: such as were asked for again since the last time."""
    known, again = held["known"], held["again"]
    kept = {k: known[k] for k in islice(again, keep)}
    known.clear()
    known.update(kept)
    again.clear()


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, however the case is written."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        free = f"__{name}"
        while free.lower() in there:
            free += "_"
        there.add(free.lower())
        out.append(free)
    return out


def partitions(df: DataFrame) -> int:
    """Number of shuffle partitions for steps whose cost is not seen in bytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


# A Bloom filter of fixed size: it only saves shuffling rows that cannot meet a join partner. When the keys
# outgrow it, it passes more rows and the join behind it stays exact.
BLOOM_BITS = 1 << 23
BLOOM_PARTS = 16
_BLOOM_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _bits_of(keys: np.ndarray, size: int = BLOOM_BITS) -> list[np.ndarray]:
    return [mix64(keys.astype(np.uint64) ^ np.uint64(s)) & np.uint64(size - 1) for s in _BLOOM_SALTS]


def bits_set(keys: np.ndarray, size: int) -> np.ndarray:
    """A packed bit set of ``size`` bits that holds the keys."""
    return bits_add(np.zeros(size // 8, np.uint8), keys)


def bits_add(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """``bits``, a packed bit set, which holds the keys from now on."""
    for at in _bits_of(keys, 8 * len(bits)):
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
    return bits


def bits_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for at in _bits_of(keys, 8 * len(bits)):
        out &= (bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return out


def either_bits(rows: DataFrame, size: int) -> np.ndarray:
    """The union of packed bit sets given as rows (part int, bits binary) of BLOOM_PARTS parts each."""

    def either(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in parts:
            for part, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                now = np.frombuffer(bits, np.uint8)
                out[part] = out[part] | now if part in out else now
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.tobytes() for x in out.values()], pa.binary())], ["part", "bits"])

    whole = np.zeros((BLOOM_PARTS, size // 8 // BLOOM_PARTS), np.uint8)
    for r in rows.repartition(BLOOM_PARTS, "part").mapInArrow(either, "part int, bits binary").collect():
        whole[r.part] |= np.frombuffer(bytes(r.bits), np.uint8)
    return whole.reshape(-1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))  # a new array, which the rest may change
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def key_filter(keys: DataFrame, col: str) -> Callable[[F.Column], F.Column]:
    """A predicate that holds for every value of the long column ``col`` of ``keys`` (and for few others).

    Each task sets bits in a table of BLOOM_BITS; the tables are or-ed part by part, so the driver sees 1 MB
    whatever the number of keys.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        for b in batches:
            bits |= bits_set(b.column(0).drop_null().to_numpy(zero_copy_only=False), BLOOM_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOOM_PARTS), pa.int32()), pa.array([p.tobytes() for p in bits.reshape(BLOOM_PARTS, -1)], pa.binary())], ["part", "bits"])

    spark = keys.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    shared = spark.sparkContext.broadcast(either_bits(keys.select(F.col(col).cast("long")).mapInArrow(build, "part int, bits binary"), BLOOM_BITS).tobytes())

    @F.pandas_udf("boolean")
    def may_hold(values):  # type: ignore[no-untyped-def]
        import pandas as pd

        hit = bits_hold(np.frombuffer(shared.value, np.uint8), values.fillna(0).to_numpy().astype(np.int64))
        return pd.Series(hit & values.notna().to_numpy())

    return may_hold


def counted(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """About how often each value of ``hashes`` mod 2**bits occurs in all rows: a table of fixed size, summed by part.

    A task counts up to 255 a value, which keeps the tables small; sums of one are exact.
    """
    size, parts = 1 << bits, 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        for b in batches:
            np.add.at(total, (hashes(b) & np.uint64(size - 1)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([p.tobytes() for p in np.minimum(total, 255).astype(np.uint8).reshape(parts, -1)], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                now = np.frombuffer(counts, np.uint8).astype(np.int32)
                out[part] = out[part] + now if part in out else now
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.astype("<i4").tobytes() for x in out.values()], pa.binary())], ["part", "counts"])

    rows = map_arrow(df, count, "part int, counts binary").repartition(parts, "part").mapInArrow(add, "part int, counts binary").collect()
    whole = np.zeros((parts, size // parts), np.int32)
    for r in rows:
        whole[r.part] += np.frombuffer(bytes(r.counts), "<i4")
    return whole.reshape(-1)


def same_session_zone(fn: Callable) -> Callable:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf)

    return run
