"""SimHash fingerprints and exact search within a Hamming radius.

The terms of a text are its pairs of neighbouring words (the first word is paired with a mark), each weighted by the
lengths of its words, so that short function words count little. Each term's 128-bit hash votes with its weight on
every bit; a fingerprint holds the signs as 32 hexadecimal digits. Equal texts have equal fingerprints, as have texts that
differ in white space only. Texts without words (null, empty, blank) have the fingerprint of zeros.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import documents, key_filter, map_arrow, mix64, partitions
from tidewatch.llm.words import BASE, Words
from tidewatch.session import settle

BITS = 128
RADIUS = 14  # bits; near copies are texts of a cosine of about 0.97, which differ by 10 bits on average
TERMS_AT_ONCE = 1 << 15


def fingerprints(texts: pa.Array) -> list[str]:
    words = Words(texts)
    h = words.hashes()
    size = np.minimum(words.ends - words.starts, 12).astype(np.float32)
    before, before_size = np.roll(h, 1), np.roll(size, 1)
    opening = words.first[:-1][words.counts() > 0]
    before[opening], before_size[opening] = 0, 1
    term = mix64(before * np.uint64(BASE) + h)
    both = np.stack([term, mix64(term + np.uint64(BASE))], 1)
    weight = size + before_size
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        votes = np.zeros(BITS, np.float64)
        for at in range(a, b, TERMS_AT_ONCE):
            to = min(b, at + TERMS_AT_ONCE)
            bits = np.unpackbits(both[at:to].view(np.uint8), axis=1).astype(np.float32)
            w = weight[at:to]
            votes += 2 * (w @ bits).astype(np.float64) - float(w.sum())
        out.append(np.packbits(votes > 0).tobytes().hex())
    return out


def likeness(a: str, b: str) -> float:
    """The cosine that the share of differing bits stands for, 0 at least."""
    return float(max(0.0, np.cos(np.pi * (int(a, 16) ^ int(b, 16)).bit_count() / BITS)))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1)), pa.string())], ["doc_id", "fingerprint"])

    return map_arrow(documents(docs, id_col, text_col), run, "doc_id long, fingerprint string")


def _blocks(radius: int) -> tuple[list[tuple[int, int]], int]:
    """Blocks of hexadecimal digits (from, to), and the bits that fingerprints within the radius differ by in one block at least.

    Were it more than radius // blocks bits in every block, it would be more than the radius in all.
    """
    n = max(3, radius // 3 + 1)
    cuts = [round(k * BITS / 4 / n) for k in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)), radius // n


def _value(col: str, block: tuple[int, int]) -> F.Column:
    return F.conv(F.substring(col, block[0] + 1, block[1] - block[0]), 16, 10).cast("long")


def _keys(prints: DataFrame, blocks: list[tuple[int, int]]) -> DataFrame:
    """(fingerprint, block, value) of each distinct fingerprint and block."""
    some = prints.select("fingerprint").where("fingerprint is not null").distinct()
    return some.select("fingerprint", F.posexplode(F.array(*(_value("fingerprint", b) for b in blocks))).alias("block", "value"))


def hamming(a: str, b: str) -> F.Column:
    """Differing bits of two columns of fingerprints."""
    return sum(
        (F.bit_count(F.conv(F.substring(a, k, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, k, 8), 16, 10).cast("long"))) for k in range(1, BITS // 4, 8)),
        F.lit(0),
    )


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fingerprint, distance): for each distinct fingerprint of ``queries`` all of ``prints`` within the radius.

    ``prints`` has one row a block; ``queries`` asks for every value that differs by up to two bits from its own.
    """
    if radius < 1 or radius > 14:
        raise ValueError("the radius lies in 1..14")
    blocks, spare = _blocks(radius)
    flips = [(n, sum(1 << k for k in bits)) for n, (a, b) in enumerate(blocks) for few in range(spare + 1) for bits in combinations(range(4 * (b - a)), few)]
    masks = queries.sparkSession.createDataFrame(flips, "block int, mask long")
    key = lambda value: (value * 8 + F.col("block")).alias("key")
    there = _keys(prints, blocks).select("fingerprint", "block", key(F.col("value")))
    # few bytes that become many rows: dealt to all tasks
    asked = _keys(queries, blocks).repartition(partitions(queries), "fingerprint", "block").join(F.broadcast(masks), "block").select(F.col("fingerprint").alias("query"), key(F.col("value").bitwiseXOR(F.col("mask"))))
    met = asked.where(key_filter(there, "key")(F.col("key"))).join(there, "key")
    # a pair counts in the first block that it meets in
    apart = [F.bit_count(_value("query", b).bitwiseXOR(_value("fingerprint", b))) for b in blocks]
    first = F.coalesce(*(F.when(x <= spare, F.lit(n)) for n, x in enumerate(apart)))
    return met.where((first == F.col("block")) & (hamming("query", "fingerprint") <= radius)).select("query", "fingerprint", hamming("query", "fingerprint").alias("distance"))


def others_within(asked: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, others): rows of ``prints`` within the radius of each distinct fingerprint of ``asked``, all copies but the asking row itself."""
    copies = prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n"))
    near = within_radius(asked, copies, radius).join(copies, "fingerprint")
    return near.groupBy(F.col("query").alias("fingerprint")).agg((F.sum("n") - 1).alias("others"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness to each other and to the next document's.

    The edited text has its last third of code points replaced by the beginning of the next document in descending
    id (after the last: the first). Rows are sorted over range partitions; only a partition's first and last row meet
    their neighbours in other partitions. Null ids come last; equal ids are ordered by their text.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = pa.schema(
        [("kind", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())]
    )
    kinds = "kind string, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"

    def rows(part: int, ids: list, texts: list[str], prints: list[str], heads: list[str], head_prints: list[str]) -> list[tuple]:
        edited = []
        for text, head in zip(texts, heads, strict=True):
            k = len(text) // 3
            edited.append(text[: len(text) - k] + head[:k])
        marks = fingerprints(pa.array(edited, pa.large_string()))
        return [
            ("done", part, i, len(t), hashlib.sha256(e.encode()).hexdigest(), p, m, likeness(p, m), likeness(p, q), None)
            for i, t, e, p, m, q in zip(ids, texts, edited, prints, marks, head_prints, strict=True)
        ]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for b in batches:
            if not b.num_rows:
                continue
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            prints = fingerprints(b.column(1))
            out = []
            if last is None:
                out.append(("head", part, ids[0], None, None, prints[0], None, None, None, texts[0]))
            else:
                ids, texts, prints = [last[0], *ids], [last[1], *texts], [last[2], *prints]
            out += rows(part, ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
            last = (ids[-1], texts[-1], prints[-1])
            yield batch(out)
        if last is not None:
            yield batch([("tail", part, last[0], None, None, last[2], None, None, None, last[1])])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, prints, heads, head_prints = (c.to_pylist() for c in b.columns)
            yield batch(rows(0, ids, [t or "" for t in texts], prints, [t or "" for t in heads], head_prints)) if ids else batch([])

    own = documents(docs, id_col, text_col)
    order = F.desc_nulls_last("doc_id")
    dealt = own.repartitionByRange(partitions(own), order).sortWithinPartitions(order, F.asc_nulls_first("text"))
    found = settle(map_arrow(dealt, run, kinds), "simhash")
    tails = found.where("kind = 'tail'").select("part", "doc_id", "text", "fingerprint")
    heads = found.where("kind = 'head'").select(F.col("part").alias("next"), F.col("text").alias("head"), F.col("fingerprint").alias("head_print"))
    parts = sorted(r.part for r in tails.select("part").collect())
    follows = own.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    edge = tails.join(F.broadcast(follows), "part").join(heads, "next").select("doc_id", "text", "fingerprint", "head", "head_print")
    return found.where("kind = 'done'").select(*names).unionByName(map_arrow(edge, close, kinds).select(*names))
