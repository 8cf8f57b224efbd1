"""Sets of tokens in rarity order: the shared parts of the two exact set-similarity joins.

Two sets are similar if 100 times their intersection is at least ``PERCENT`` times their union. With tokens in one global
order, rare ones first, similar sets share a token among their first n - ceil(n * PERCENT / 100) + 1. The order is by
counts in a table of fixed size; it decides how much is filtered, not the result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import map_arrow, mix64, partitions
from tidewatch.session import settle

PERCENT = 75
LEVEL_BITS = 10
PROFILE_BITS = 512  # of a set's parity bitmap
#: Takes a batch and gives the owner (ascending, from 0) and the hash of each token, and the number of owners.
Tokens = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, int]]


def levels(rarity: np.ndarray) -> np.ndarray:
    """The place of each slot's tokens in the order by rarity, from its count."""
    return np.minimum(np.log2(np.maximum(rarity, 1)) * 40, (1 << LEVEL_BITS) - 1).astype(np.uint16)


class OrderedSets:
    """Distinct tokens of each owner in rarity order. ``level``, if it is at hand, is that of ``rarity``."""

    def __init__(self, owner: np.ndarray, token: np.ndarray, owners: int, rarity: np.ndarray | None, percent: int = PERCENT, level: np.ndarray | None = None):
        # owners ascend, so that only tokens move; sorting numbers that hold their place is much faster than argsort
        at, who = len(token).bit_length(), max(owners, 1).bit_length()
        free, mask = 64 - at - who, np.uint64((1 << at) - 1)
        high, place = owner.astype(np.uint64) << np.uint64(64 - who), np.arange(len(token), dtype=np.uint64)
        order = np.zeros(0, np.uint64)
        if free > 0:
            order = np.sort(high | (token >> np.uint64(64 - free) << np.uint64(at)) | place)
            same = order[1:] >> np.uint64(at) == order[:-1] >> np.uint64(at)
            after = token[(order & mask).astype(np.int64)]
        if free <= 0 or (same & (after[1:] != after[:-1])).any():  # tokens that the bits left for them don't tell apart
            after = token[np.lexsort((token, owner))]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (after[1:] != after[:-1])
        owner, token = owner[fresh], after[fresh]
        self.size = np.bincount(owner, minlength=owners).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(token ^ np.uint64(s)))]) for s in (0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03)]
        #: Two 64-bit keys of each set, whatever the order of its tokens.
        self.keys = [mix64(x[self.first[1:]] - x[self.first[:-1]] + self.size.astype(np.uint64)) for x in sums]
        self.sorted = token
        if rarity is not None:
            self.rarity = rarity
            level = (levels(rarity) if level is None else level)[(token & np.uint64(len(rarity) - 1)).astype(np.int64)]
            if free >= LEVEL_BITS:
                order = (np.sort(high[fresh] | (level.astype(np.uint64) << np.uint64(at)) | place[: len(token)]) & mask).astype(np.int64)
            else:
                order = np.lexsort((level, owner))
            self.owner, self.token = owner, token[order]
            self.place = np.arange(len(token)) - np.repeat(self.first[:-1], self.size)
            length = self.size - -(-self.size * percent // 100) + 1
            self.in_prefix = self.place < np.repeat(length, self.size)

    def counts(self, at: np.ndarray) -> np.ndarray:
        """How often the tokens at these places occur."""
        return self.rarity[(self.token[at] & np.uint64(len(self.rarity) - 1)).astype(np.int64)]

    @functools.cached_property
    def group(self) -> np.ndarray:
        """Key of prefix and size, by which sets are grouped."""
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(self.in_prefix, mix64(self.token), np.uint64(0)), dtype=np.uint64)])
        return mix64(prefix[self.first[1:]] - prefix[self.first[:-1]] + mix64(self.size.astype(np.uint64)))


def bitmaps(sets: OrderedSets, bits: int) -> np.ndarray:
    """Parity of each set's tokens over ``bits`` places, packed in rows of bytes.

    Two sets whose bitmaps differ in d places differ in d tokens at least, which bounds their intersection.
    """
    n = len(sets.size)
    owner = np.repeat(np.arange(n), sets.size)
    place = (sets.sorted >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(owner * bits + place, minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


POSTING = np.dtype([("token", "<u8"), ("gid", "<i8"), ("n", "<i4"), ("place", "<i4")])
FLUSH = 1_000_000  # postings a task holds before it sends them
BLOCK = 200_000  # postings of a block, about
MANY = 16  # postings of a token at which a task needs no other to know that the token is shared


def profiles(own: DataFrame, tokens: Tokens, rarity: np.ndarray, head: str, named: Callable[[pa.RecordBatch], list[pa.Array]], percent: int = PERCENT) -> DataFrame:
    """One row per set: the columns ``head`` given by ``named``, n, keys, group and bitmap."""
    shared = own.sparkSession.sparkContext.broadcast(rarity)
    names = [x.split()[0] for x in head.split(", ")] + ["n", "one", "two", "gid", "bitmap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels(shared.value)
        for b in batches:
            sets = OrderedSets(*tokens(b), shared.value, percent, level)
            signed = [pa.array(x.view(np.int64)) for x in (*sets.keys, sets.group)]
            maps = pa.array(list(bitmaps(sets, PROFILE_BITS).view("<i8")), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*named(b), pa.array(sets.size), *signed, maps], names)

    return map_arrow(own, run, f"{head}, n long, one long, two long, gid long, bitmap array<long>")


def shared_lists(own: DataFrame, tokens: Tokens, rarity: np.ndarray, postings: int, percent: int = PERCENT) -> DataFrame:
    """(token, gid, n, place): the prefix tokens of two groups or more, a row for each group; rows may repeat.

    Tasks send postings in blocks by token, a group once a task, and a block keeps the tokens of two groups. Of a token
    that a task holds ``MANY`` times, two postings go to its block, as a sign to the others; the rest is known to be
    shared and is dealt by group, so no block grows with a frequent token. ``postings`` gives the number of blocks.
    """
    spark = own.sparkSession
    shared = spark.sparkContext.broadcast(rarity)
    parts = partitions(own)
    blocks = max(parts, postings // BLOCK + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        count = 0

        def out() -> pa.RecordBatch:
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows["token"], kind="stable")]
            token = rows["token"]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.concatenate([starts, [len(rows)]]))
            rank = np.arange(len(rows)) - np.repeat(starts, length)
            sure = (np.repeat(length, length) >= MANY) & (rank >= 2)
            by = np.where(sure, mix64(rows["gid"].view(np.uint64)), token >> np.uint64(20))
            place = 2 * (by % np.uint64(blocks)).astype(np.int64) + sure
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.diff(place[order], prepend=-1))
            ends = np.concatenate([cuts[1:], [len(rows)]])
            # column by column, which compresses better
            packed = [b"".join(np.ascontiguousarray(rows[name][order[x:y]]).tobytes() for name in POSTING.names) for x, y in zip(cuts, ends, strict=True)]
            first = place[order[cuts]]
            return pa.RecordBatch.from_arrays([pa.array(first // 2), pa.array(first % 2 == 1), pa.array(packed, pa.binary())], ["block", "sure", "postings"])

        level = levels(shared.value)
        for b in batches:
            sets = OrderedSets(*tokens(b), shared.value, percent, level)
            group = sets.group.view(np.int64)
            new = np.zeros(len(group), bool)
            for i, g in enumerate(group.tolist()):
                if g not in seen:
                    seen.add(g)
                    new[i] = True
            # a count of one means that no other set holds the token
            i = np.flatnonzero(sets.in_prefix & new[sets.owner])
            i = i[sets.counts(i) > 1]
            rows = np.zeros(len(i), POSTING)
            for name, value in (("token", sets.token[i]), ("gid", group[sets.owner[i]]), ("n", sets.size[sets.owner[i]]), ("place", sets.place[i])):
                rows[name] = value
            held.append(rows)
            count += len(i)
            if count > FLUSH:
                yield out()
                held, count = [], 0
        if count:
            yield out()

    def unpacked(held: list[bytes]) -> np.ndarray:
        whole = []
        for raw in held:
            rows, at = np.zeros(len(raw) // POSTING.itemsize, POSTING), 0
            for name in POSTING.names:
                rows[name] = np.frombuffer(raw, POSTING[name], len(rows), at)
                at += POSTING[name].itemsize * len(rows)
            whole.append(rows)
        return np.concatenate(whole)

    def rows_of(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(x), 100_000):
            y = x[at : at + 100_000]
            columns = [pa.array(np.ascontiguousarray(y[c])) for c in ("gid", "n", "place")]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(y["token"]).view(np.int64)), *columns], ["token", "gid", "n", "place"])

    def judged(held: list[bytes]) -> np.ndarray:
        x = unpacked(held)
        x = x[np.lexsort((x["gid"], x["token"]))]
        token, gid = x["token"], x["gid"]
        fresh = np.ones(len(x), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (gid[1:] != gid[:-1])
        x = x[fresh]
        same = x["token"][1:] == x["token"][:-1]
        two = np.zeros(len(x), bool)
        two[1:] |= same
        two[:-1] |= same
        return x[two]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by block: one block is held at a time
        held: list[bytes] = []
        now = None
        for batch in batches:
            for block, sure, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if sure:
                    yield from rows_of(unpacked([raw.as_py()]))
                    continue
                if block != now and held:
                    yield from rows_of(judged(held))
                    held = []
                now = block
                held.append(raw.as_py())
        if held:
            yield from rows_of(judged(held))

    dealt = map_arrow(own, send, "block long, sure boolean, postings binary").repartition(parts, "block").sortWithinPartitions("block")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    return dealt.mapInArrow(meet, "token long, gid long, n int, place int")


def large_enough(a: str, b: str, percent: int = PERCENT) -> F.Column:
    """Length filter on two sizes."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def first_shared(a: str, b: str, p: str, q: str, percent: int = PERCENT) -> F.Column:
    """Positional filter at the places p and q of a shared token; similar sets pass it at the first token they share.

    Nothing before that token is common, so what is left of either set holds the whole intersection.
    """
    needed = F.ceil((F.col(a) + F.col(b)) * percent / (100 + percent))
    return F.least(F.col(a) - F.col(p), F.col(b) - F.col(q)) >= needed


def bitmaps_allow(n: str, m: str, x: str, y: str, percent: int = PERCENT) -> F.Column:
    """Bitmap filter: differing bits against the most tokens that similar sets of these sizes may differ in."""
    differing = F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, c: s + c)
    both = F.col(n) + F.col(m)
    return differing <= both - 2 * F.ceil(both * percent / (100 + percent))


def stars(lists: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each token; rows are cut before the shuffle too."""
    return lists.withColumn("__rank", F.row_number().over(Window.partitionBy("token").orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")


def similar(x: OrderedSets, y: OrderedSets, percent: int = PERCENT) -> np.ndarray:
    """Of each owner, whether its set in ``x`` and that in ``y`` are similar."""
    n = len(x.size)
    owner, token = np.concatenate([np.repeat(np.arange(n), s.size) for s in (x, y)]), np.concatenate([x.sorted, y.sorted])
    order = np.argsort(owner, kind="stable")
    union = OrderedSets(owner[order], token[order], n, None).size
    both = x.size + y.size - union
    return (both > 0) & (100 * both >= percent * union)


def verified(pairs: DataFrame, texts: DataFrame, tokens: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, int]], percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose texts, (node, text) in ``texts``, have similar sets of tokens, stored.

    Texts travel rather than sets: they are shorter, and compress.
    """
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (OrderedSets(*tokens(batch.column(c)), None) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(similar(x, y, percent)))

    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select("a", "b").schema.fields)
    return settle(map_arrow(met, run, kinds).distinct(), "setjoin-links")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for every node of a link.

    Stars are grown and shrunk in turn (each node's neighbours are joined to its least one) until nothing changes;
    every round is written, so a lost executor costs one round.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = settle(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = tuple(now)
