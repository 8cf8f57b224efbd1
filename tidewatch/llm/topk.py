"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights. Candidates are stored in blocks; a block holds, per term (component), the
postings (candidate, weight) of its non-zero weights. For each block of queries the non-zero query weights of a
term are scattered, times the postings, into a dense array of scores; the best k per query and block are selected
by partition and merged over the blocks.

Vectors that are null, or hold null, NaN or infinite components, take no part. Vectors may differ in length: what
is missing counts as zero. Ties go to the smaller id. Rows that repeat an id are separate candidates; no row with the
query's own id is a candidate, and repeated query ids give one list, that of the least vector. Null ids take no part.
Empty vectors score zero. Scores are exact; a component or a score that a 64-bit integer can't hold is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import settle

CANDIDATES = 4096  # rows in a block of candidates
QUERIES = 512  # rows in a block of queries


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, weights array<long>): floor(scale * x), without vectors that can't be searched."""
    x = F.col(vector_col).cast("array<double>")
    plain = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    beyond = F.raise_error(F.lit(f"a component times {scale} is beyond 64-bit integers")).cast("long")
    whole = F.transform(x, lambda v: F.when(F.abs(v * scale) < float(1 << 62), F.floor(v * scale)).otherwise(beyond))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(plain).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("weights"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, ids, lengths, flat) with at most ``size`` rows each, packed as little-endian 64-bit integers."""
    schema = pa.schema([("ids", pa.binary()), ("lengths", pa.binary()), ("flat", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate([h[k] for h in held]).astype("<i8").tobytes()], pa.binary()) for k in range(3)], schema=schema)

        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                if count + part.num_rows > size:
                    yield out()
                    held, count = [], 0
                held.append((part.column(0).to_numpy(), part.column(1).value_lengths().to_numpy(), part.column(1).flatten().to_numpy()))
                count += part.num_rows
        if held:
            yield out()

    blocks = rows.mapInArrow(run, "ids binary, lengths binary, flat binary")
    return blocks.withColumn("block", F.monotonically_increasing_id())


def _unpack(ids: bytes, lengths: bytes, flat: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and the dense matrix of weights, as wide as the longest vector."""
    own, size, values = (np.frombuffer(x, "<i8") for x in (ids, lengths, flat))
    dense = np.zeros((len(own), int(size.max(initial=0))), np.int64)
    dense[np.arange(dense.shape[1]) < size[:, None]] = values
    order = np.argsort(own, kind="stable")
    return own[order], dense[order]


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores (query, candidate), term by term over the postings of each term."""
    most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if most(queries) * most(candidates) * max(1, queries.shape[1]) >= 1 << 62:  # a sum may not fit: unbounded integers
        queries, candidates = queries.astype(object), candidates.astype(object)
    scores = np.zeros((len(queries), len(candidates)), queries.dtype)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        posting = np.flatnonzero(candidates[:, term])
        rows = np.flatnonzero(queries[:, term])
        if not len(posting) or not len(rows):
            continue
        weighted = queries[rows, term][:, None] * candidates[posting, term][None, :]
        if len(rows) == len(queries) and len(posting) == len(candidates):
            scores += weighted
        else:
            scores[rows[:, None], posting[None, :]] += weighted
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ``ids`` ascend and ``own`` is left out."""
    there = np.flatnonzero(ids != own)
    if len(there) > k:
        least = np.partition(scores[there], len(there) - k)[len(there) - k]
        above = there[scores[there] > least]
        there = np.concatenate([above, there[scores[there] == least][: k - len(above)]])
    return there[np.lexsort((ids[there], -scores[there]))]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, candidates_block: int = CANDIDATES, queries_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) from two tables (vec_id, weights)."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = settle(_blocks(queries.groupBy("vec_id").agg(F.min("weights").alias("weights")), queries_block), "topk-queries").withColumnsRenamed({"ids": "q_ids", "lengths": "q_lengths", "flat": "q_flat", "block": "q_block"})
    there = settle(_blocks(rows, candidates_block), "topk-rows")
    # Which query block meets which candidate block: by their numbers, then each meets its own data.
    q_numbers = [r.q_block for r in asked.select("q_block").collect()]
    pairs = there.withColumn("q_block", F.explode(F.array(*[F.lit(x).cast("long") for x in q_numbers]) if q_numbers else F.array().cast("array<long>")))
    met = pairs.repartition(n, "q_block", "block").join(asked, "q_block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                q_ids, q = _unpack(r.q_ids, r.q_lengths, r.q_flat)
                ids, c = _unpack(r.ids, r.lengths, r.flat)
                found: list[tuple[np.ndarray, ...]] = []
                for at in range(0, len(q_ids), 64):  # the score array stays in the cache
                    scores = accumulate(q[at : at + 64], c)
                    for j, own in enumerate(q_ids[at : at + 64]):
                        places = best(scores[j], ids, int(own), k)
                        found.append((np.full(len(places), own), ids[places], scores[j][places]))
                if any(f[2].dtype == object and any(abs(v) >> 63 for v in f[2]) for f in found):
                    raise OverflowError("a score is beyond 64-bit integers")
                yield pd.DataFrame({"query_id": np.concatenate([f[0] for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2].astype(np.int64) for f in found])})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    found = met.select("q_ids", "q_lengths", "q_flat", "ids", "lengths", "flat").mapInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
