"""Compression of vectors to codes: one small codebook per part of the vector, trained by exact integer Lloyd rounds.

Each component x counts as the integer floor(scale * x). A vector is cut into equal consecutive parts. A part's
codebook starts as that part of the vectors with the smallest ids; a round assigns every part to its nearest entry
(squared distance, ties to the lower index) and moves every used entry to the floor of its parts' mean.

Method: active entries. A row keeps, per part, its entry and the exact distance. After a round only the entries that
moved are active: a part whose own entry stayed compares its stored distance with the distances to the moved entries
alone, since those to the others are what they were and lost before; a part whose entry moved is scanned against all.
Equal distances go to the lower index in both. Codebooks have a fixed size and are sent to the tasks; each task sums
its own rows, the sums meet by (part, entry), and the driver sees one row per entry.

Arithmetic is exact: in doubles where no sum can pass 2 ** 53, in 64-bit integers up to 2 ** 62, in unbounded integers
beyond. An error that a long can't hold is null. Vectors that are null or hold null, NaN or infinite components are
left out. A vector whose length is not a multiple of the number of parts, or that is shorter than others, counts as
filled up with zeros; empty vectors count as zeros. Null ids come last in the order of ids, rows that share an id are
ordered by their vector, repeated rows are separate. With fewer vectors than entries the codebooks are smaller; an
empty table has no rows and empty codebooks. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import partitions
from tidewatch.session import settle

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
SALTS = 64  # pieces of a label's rows, so that a label with most rows is joined by many tasks


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): 64-bit integers if all fit well, else Python's."""
    if not len(x) or np.abs(x).max() < 2.0**40:
        return np.floor(x * scale).astype(np.int64)
    return np.array([int(v) * scale if abs(v) >= 2.0**60 else int(np.floor(v * scale)) for v in x.tolist()], object)


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (row, entry)."""
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    bound = 4 * most * most * max(1, rows.shape[1])
    if bound >= 1 << 62:
        rows, entries = rows.astype(object), entries.astype(object)
    elif bound < 1 << 53:
        rows, entries = rows.astype(np.float64), entries.astype(np.float64)
    out = (rows * rows).sum(1)[:, None] - 2 * (rows @ entries.T) + (entries * entries).sum(1)[None, :]
    return out.astype(np.int64) if out.dtype == np.float64 else out


def nearest(rows: np.ndarray, entries: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of the nearest of all entries, or of those numbered ``only``; ties to the lower index."""
    found = distances(rows, entries if only is None else entries[only])
    at = np.argmin(found, axis=1)
    return at if only is None else only[at], found[np.arange(len(rows)), at]


def reassign(rows: np.ndarray, entries: np.ndarray, moved: np.ndarray, own: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries after some moved, from the entry and distance that each row had before."""
    own, least = own.copy(), least.copy()
    active = np.zeros(len(entries), bool)
    active[moved] = True
    again = active[own]
    if again.any():
        at, far = nearest(rows[again], entries)
        if far.dtype == object and least.dtype != object:
            least = least.astype(object)
        own[again], least[again] = at, far
    fixed = np.flatnonzero(~again)
    if len(fixed) and len(moved):
        at, far = nearest(rows[fixed], entries, moved)
        better = (far < least[fixed]) | ((far == least[fixed]) & (at < own[fixed]))
        if far.dtype == object and least.dtype != object:
            least = least.astype(object)
        own[fixed[better]], least[fixed[better]] = at[better], far[better]
    return own, least


def plain(vector: Column) -> Column:
    """The vector is there and all its components are finite."""
    x = vector.cast("array<double>")
    return F.coalesce(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


def _matrix(b: pa.RecordBatch, col: str, width: int, scale: int) -> np.ndarray:
    """Integer rows of one width; missing components are zero."""
    size = b.column(col).value_lengths().to_numpy(zero_copy_only=False)
    flat = integers(b.column(col).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), scale)
    out = np.zeros((b.num_rows, width), flat.dtype)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _far_columns(far: np.ndarray) -> list[pa.Array]:
    """Distances per row: as packed 64-bit integers, or as digits where those don't hold a batch's distances."""
    none = [None] * len(far)
    if far.dtype != object or max(far.max(initial=0), 0) < 1 << 62:
        return [pa.array([r.tobytes() for r in far.astype("<i8")], pa.binary()), pa.array(none, pa.string())]
    return [pa.array(none, pa.binary()), pa.array([",".join(map(str, r)) for r in far], pa.string())]


def _far_rows(far: pa.Array, beyond: pa.Array, parts: int) -> np.ndarray:
    if not far.null_count:
        return np.frombuffer(b"".join(far.to_pylist()), "<i8").reshape(len(far), parts)
    rows = [np.frombuffer(f, "<i8").tolist() if f is not None else list(map(int, t.split(","))) for f, t in zip(far.to_pylist(), beyond.to_pylist(), strict=True)]
    return np.array(rows, object).reshape(len(far), parts)


@dataclass
class Codes:
    """``rows``: (vec_id, label, code string, error, label_error). ``codebooks``: (part, entry, component) integers."""

    rows: DataFrame
    codebooks: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.codebooks.ravel()).encode()).hexdigest()


def _assigned(rows: DataFrame, books: np.ndarray, moved: list[np.ndarray] | None, scale: int, keep: bool) -> DataFrame:
    """Rows with ``own`` (an entry per part, a byte each) and ``far``; ``moved`` None means a first, whole scan.

    ``keep`` passes the vectors on for a further round, else the code and the error come instead.
    """
    parts, _, width = books.shape
    names = ["vec_id", "label", *(["x", "own", "far", "beyond"] if keep else ["code", "error"])]
    vector_type = dict(rows.dtypes)["x"]
    shape = f"vec_id long, label {dict(rows.dtypes)['label']}, " + (f"x {vector_type}, own binary, far binary, beyond string" if keep else "code string, error long")
    shared = rows.sparkSession.sparkContext.broadcast((books, moved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            there = _matrix(b, "x", parts * width, scale)
            own, far = np.zeros((b.num_rows, parts), np.int64), np.zeros((b.num_rows, parts), object if there.dtype == object or books.dtype == object else np.int64)
            if moved is not None:
                was = np.frombuffer(b"".join(b.column("own").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
                was_far = _far_rows(b.column("far"), b.column("beyond"), parts)
                far = far.astype(object) if was_far.dtype == object else far
            for p in range(parts):
                piece = there[:, p * width : (p + 1) * width]
                if moved is None:
                    own[:, p], least = nearest(piece, books[p])
                else:
                    own[:, p], least = reassign(piece, books[p], moved[p], was[:, p], was_far[:, p])
                far = far.astype(object) if least.dtype == object else far
                far[:, p] = least
            small = own.astype(np.uint8)
            if keep:
                more = [b.column("x"), pa.array([r.tobytes() for r in small], pa.binary()), *_far_columns(far)]
            else:
                sums = [sum(r) for r in far.tolist()]
                more = [pa.array([r.tobytes().hex() for r in small], pa.string()), pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), *more], names=names)

    return rows.mapInArrow(run, shape)


def _moved(state: DataFrame, books: np.ndarray, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The next codebooks and, per part, the entries that differ."""
    parts, entries, width = books.shape
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.string()))])
    shape = "part int, entry int, n long, total array<string>"

    def give(n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        rows = [{"part": p, "entry": e, "n": int(n[p, e]), "total": [str(v) for v in total[p, e]]} for p, e in zip(*np.nonzero(n), strict=True)]
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for b in batches:
            there = _matrix(b, "x", parts * width, scale)
            own = np.frombuffer(b"".join(b.column("own").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                n[p] += np.bincount(own[:, p], minlength=entries)
                part = np.zeros((entries, width), there.dtype)  # a batch's sum of numbers below 2 ** 48 fits
                np.add.at(part, own[:, p], there[:, p * width : (p + 1) * width])
                total[p] += part
        if n.any():
            yield give(n, total)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for b in batches:
            for r in b.to_pylist():
                n[r["part"], r["entry"]] += r["n"]
                total[r["part"], r["entry"]] += np.array([int(v) for v in r["total"]], object)
        if n.any():
            yield give(n, total)

    met = state.select("x", "own").mapInArrow(add, shape).repartition(partitions(state), "part", "entry").mapInArrow(meet, shape)
    after = books.astype(object)
    for r in met.collect():  # parts x entries rows at most
        after[r["part"], r["entry"]] = [int(v) // r["n"] for v in r["total"]]
    if all(abs(int(v)) < 1 << 62 for v in after.ravel()):
        after = after.astype(np.int64)
    return after, [np.flatnonzero((after[p] != books[p]).any(axis=1)) for p in range(parts)]


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Codes:
    """Codes of all vectors after ``rounds`` rounds and a last assignment. ``entries`` is at most 256: an index is a byte."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must lie in 1 .. 256")
    x = F.col(vector_col)
    rows = vectors.where(plain(x)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), x.alias("x"))
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    # First the ids alone, so that few vectors leave their tasks; null ids count where there are not enough others.
    ids = [r["vec_id"] for r in rows.where(F.col("vec_id").isNotNull()).select("vec_id").orderBy("vec_id").limit(entries).collect()]
    some = rows.where(F.col("vec_id") <= ids[-1]) if len(ids) == entries else rows
    first = some.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = [integers(np.array([*r["x"], *[0.0] * (parts * width - len(r["x"]))], np.float64), scale) for r in first]
    books = np.stack(start).reshape(len(start), parts, width).transpose(1, 0, 2) if start else np.zeros((parts, 0, width), np.int64)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    moved = None
    state = rows
    for _ in range(rounds if start else 0):
        state = settle(_assigned(state, books, moved, scale, keep=True), "codes")
        books, moved = _moved(state, books, scale)
    coded = settle(_assigned(state, books, moved, scale, keep=False), "coded")
    # A label's total, first by piece of its rows: pieces meet their own total, so no task has all rows of a label.
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    pieces = settle(salted.groupBy("label", "salt").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("part"), F.count_if(F.col("error").isNull()).alias("beyond")), "codes-labels")
    total = pieces.groupBy("label").agg(F.sum("part").alias("total"), F.sum("beyond").alias("beyond"))
    total = total.select(F.col("label").alias("of"), F.when((F.col("beyond") == 0) & (F.col("total") <= (1 << 63) - 1), F.col("total")).cast("long").alias("label_error"))
    by_piece = pieces.select("label", "salt").join(total, F.col("label").eqNullSafe(F.col("of"))).select(F.col("label").alias("of"), F.col("salt").alias("piece"), "label_error")
    out = salted.join(by_piece, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("piece")))
    return Codes(out.select("vec_id", "label", "code", "error", "label_error"), books)
