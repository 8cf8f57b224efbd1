"""Line dedup: an exact set-similarity join of lines by their words.

A line's set holds its distinct words, A-Z in lower case. Words are ordered by rarity; two lines are compared if they share
one of their first words (prefix filter), their sizes allow the similarity (length filter), what follows the first
shared word in both still allows it (positional filter), and so do their parity bitmaps. The Jaccard similarity of the
whole sets decides. A line that is similar to an earlier line, by (id, number in the text), is removed; lines are judged
on the input, not on what is left.

Of equal sets all but the earliest go, without a comparison. The others need one similar earlier set each, so at most
``FEW`` candidates of a shared word are verified first; the lists of words at which a line had more are stored beside the
pairs, and lines without a match meet all the rest of them. The texts are read twice: once for copies of sets and counts of
words, once for postings; and again for the lines of pairs, which a bit set of lines finds without a join.

No word's list lies in one task: a word that is in the prefixes of more than ``BLOCK`` lines is split by the sets' keys. How many
those are is estimated from documents chosen by a hash (one in 32, so that a list of ``BLOCK`` shows ``SHOWN`` lines); the estimate
decides where rows lie, never which rows meet. A split list is compared within its parts first; its lines without a match are
then sent to all parts, one part and one run of such lines at a time.

Lines end at line feeds. Lines of fewer than ``least`` words stay and match nothing, as do lines of rows with a null id; with
``least`` 1, as the query and the pipeline have it, that holds for blank lines only. Sets so small that only equal ones are
similar (of one or two words at 75 percent) have no postings: their copies are found by the set's key.
null texts stay null. Lines with equal number of rows that repeat an id do not remove each other. Nothing else of a row
changes, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import setjoin
from tidewatch.llm.common import BLOOM_BITS, BLOOM_PARTS, bits_add, bits_hold, documents, either_bits, give_back, key_filter, map_arrow, mix64, partitions, unused
from tidewatch.llm.words import Words
from tidewatch.session import settle

LEAST = 5  # words
RARITY_BITS = 20
FEW = 16
BITMAP = 128  # bits
FLUSH = 250_000  # postings a task holds
BLOCK = 200_000  # postings of a block, about
SHOWN = 6_250  # postings by which the length of a list that needs a split is estimated
PAIRS = 500_000  # pairs compared at once
MOST_BITS = 1 << 26  # of the bit set of lines whose texts are fetched


def joins(n, percent: int):  # type: ignore[no-untyped-def]
    """Whether a set of n words can be similar to another than an equal one: to itself with one word more."""
    return n * 100 >= (n + 1) * percent


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, line, begin) of all lines of the texts data[offsets[d]:offsets[d + 1]]."""
    feeds = np.flatnonzero(data == 10)
    count = np.diff(np.searchsorted(feeds, offsets)) + 1  # lines of each text
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(count)), count)
    begin = np.zeros(len(doc), np.int64)
    begin[first] = offsets[:-1]
    later = np.ones(len(doc), bool)
    later[first] = False
    begin[later] = feeds + 1
    return doc, (np.arange(len(doc)) - first[doc]).astype(np.int32), begin


class Lines:
    """The lines of a batch that have ``least`` words or more."""

    def __init__(self, texts: pa.Array, least: int):
        words = Words(texts, lower=True)
        doc, line, begin = line_starts(words.data, words.offsets)
        length = np.diff(np.append(np.searchsorted(words.starts, begin), len(words)))
        long = length >= max(least, 1)
        self.owner, self.token = np.repeat(np.arange(int(long.sum())), length[long]), words.hashes()
        if len(self.owner) < len(self.token):
            self.token = self.token[np.repeat(long, length)]
        self.n = int(long.sum())
        self.doc = doc[long]
        self.line = line[long]


RECORD = np.dtype([("token", "<u8"), ("key", "<u8"), ("x", "<u8"), ("y", "<u8"), ("doc", "<i8"), ("hash", "<i8"), ("line", "<i4"), ("n", "<i4"), ("p", "<i4")])
#: Of words and keys 40 bits travel. Words that agree in them share a list, which only adds candidates; equal sets are told by
#: key, size, place and bitmap together.
SHORT = 40
WIRE = [(name, shift, kind) for name in ("token", "key") for shift, kind in ((0, "<u4"), (32, "u1"))] + [(name, 0, RECORD[name].str) for name in RECORD.names[2:]]
WIDTH = sum(np.dtype(kind).itemsize for *_, kind in WIRE)


def in_order(postings: dict[str, np.ndarray], last: np.ndarray | None = None) -> np.ndarray:
    """Places of the postings in order of token, id, line and text, at last by ``last``."""
    token, place = postings["token"], [postings[c] for c in (["doc", "line", "hash"] if postings["hash"].any() else ["doc", "line"])]
    bits = len(token).bit_length()
    if last is None and len(token) and int(token.max()) >> (64 - bits) == 0:
        # tasks send lines in their order, and mostly that of the ids
        order = np.argsort(place[0], kind="stable")
        sorted_by = [v[order] for v in place]
        if len(place) > 2 or ((sorted_by[0][1:] == sorted_by[0][:-1]) & (sorted_by[1][1:] < sorted_by[1][:-1])).any():
            order = np.lexsort(place[::-1])
        return order[(np.sort(token[order] << np.uint64(bits) | np.arange(len(token), dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)]
    return np.lexsort([*([] if last is None else [last]), *place[::-1], token])


def candidates(postings: dict[str, np.ndarray], percent: int, few: int | None, seekers: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(postings in order, later, earlier, full): rows of sets that pass the filters at a token, and the rows that have more.

    Each later row takes its earliest ``few`` candidates of a token; None takes all. ``seekers`` tells the rows that
    seek as later ones; the others are only found. A pair is met at the first token that
    its sets share: nothing before it is common, so the rest of either set holds the whole intersection.
    """
    wanted = np.ones(len(postings["token"]), bool) if seekers is None else seekers
    order = in_order(postings, None if seekers is None else ~wanted)
    # copies of a set that other tasks sent: the earliest stays, and of a row that comes twice the one that seeks
    bits = len(order).bit_length()
    low = np.uint64((1 << bits) - 1)
    alike = np.sort(((mix64(postings["token"]) ^ postings["key"])[order] & ~low) | np.arange(len(order), dtype=np.uint64))
    same = np.flatnonzero(alike[1:] >> np.uint64(bits) == alike[:-1] >> np.uint64(bits))
    before, after = ((alike[same + k] & low).astype(np.int64) for k in range(2))
    equal = np.ones(len(same), bool)
    for c in ("token", "key", "n", "p", "x", "y"):
        equal &= postings[c][order[after]] == postings[c][order[before]]
    stays = np.ones(len(order), bool)
    stays[after[equal]] = False
    order = order[stays]
    postings, wanted = {c: v[order] for c, v in postings.items()}, wanted[order]
    token, n, x, y, doc, line, text = (postings[c] for c in ("token", "n", "x", "y", "doc", "line", "hash"))
    left = n - postings["p"]  # 32 bits, as n
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([starts, [len(token)]]))
    start = np.repeat(starts, length)
    rank = np.arange(len(token)) - start
    found = np.zeros(len(token), np.int64)
    later, earlier = [], []
    at, step = 0, 64
    active = np.flatnonzero((rank > 0) & wanted)
    while len(active):
        width = np.minimum(rank[active] - at, step)
        ends = np.cumsum(width)
        cut = 0
        while cut < len(active):
            base = ends[cut - 1] if cut else 0
            to = max(cut + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
            rows, w = active[cut:to], width[cut:to]
            b = np.arange(int(w.sum())) + np.repeat(start[rows] + at - np.cumsum(w) + w, w)
            # the intersection must reach this, and both sets must still have as much
            both = np.repeat(n[rows], w) + n[b]
            needed = -(both * -percent // (100 + percent))
            good = np.flatnonzero(np.minimum(np.repeat(left[rows], w), left[b]) >= needed)
            a, b, spare = np.repeat(rows, w)[good], b[good], (both - 2 * needed)[good]
            good = np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent
            good &= np.bitwise_count(x[a] ^ x[b]).astype(np.int32) + np.bitwise_count(y[a] ^ y[b]) <= spare
            good &= (doc[a] != doc[b]) | (line[a] != line[b]) | (text[a] != text[b])
            a, b = a[good], b[good]
            if few is not None and len(a):
                fresh = np.concatenate([[True], a[1:] != a[:-1]])
                order = np.arange(len(a)) - np.repeat(np.flatnonzero(fresh), np.diff(np.concatenate([np.flatnonzero(fresh), [len(a)]])))
                keep = found[a] + order < few
                found += np.bincount(a, minlength=len(found))
                a, b = a[keep], b[keep]
            later.append(a)
            earlier.append(b)
            cut = to
        at += step
        active = active[(rank[active] > at) & ((found[active] < few) if few is not None else True)]
    a = np.concatenate(later) if later else np.zeros(0, np.int64)
    b = np.concatenate(earlier) if earlier else np.zeros(0, np.int64)
    full = found >= few if few is not None else np.zeros(len(token), bool)
    return postings, a, b, full


def pack(rows: dict[str, np.ndarray] | np.ndarray, at: np.ndarray | slice = slice(None)) -> bytes:
    """Postings column by column, which compresses better: WIDTH bytes each."""
    return b"".join((rows[name][at] >> shift if shift else rows[name][at]).astype(kind).tobytes() for name, shift, kind in WIRE)


def unpack(held: list[bytes]) -> dict[str, np.ndarray]:
    columns = {c: np.zeros(sum(map(len, held)) // WIDTH, RECORD[c]) for c in RECORD.names}
    begin = 0
    for raw in held:
        rows, at = len(raw) // WIDTH, 0
        for name, shift, kind in WIRE:
            part = np.frombuffer(raw, kind, rows, at)
            columns[name][begin : begin + rows] |= part.astype(RECORD[name]) << shift if shift else part
            at += part.nbytes
        begin += rows
    return columns


def squeeze(raw: bytes) -> bytes:
    """Compressed, behind the length: a codec of Spark's shuffle that looks for repeats only leaves much of the small numbers."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(raw: bytes) -> bytes:
    return pa.decompress(memoryview(raw)[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


PAIR = "ad long, al int, ah long, bd long, bl int, bh long, more boolean"


def _pairs(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, more: np.ndarray, rest: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of PAIR, and ``rest`` empty columns (token, postings) behind."""
    names = ["ad", "al", "ah", "bd", "bl", "bh", "more", "token", "postings"]
    for at in range(0, len(a), 100_000):
        x, y = a[at : at + 100_000], b[at : at + 100_000]
        columns = [pa.array(c) for c in (rows["doc"][x], rows["line"][x], rows["hash"][x], rows["doc"][y], rows["line"][y], rows["hash"][y], more[x])]
        columns += [pa.nulls(len(x), t) for t in (pa.int64(), pa.binary())[:rest]]
        yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])


def _list(token: int | None, raw: bytes) -> pa.RecordBatch:
    one = [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())]
    return pa.RecordBatch.from_arrays([*one, pa.array([token], pa.int64()), pa.array([raw], pa.binary())], ["ad", "al", "ah", "bd", "bl", "bh", "more", "token", "postings"])


def _nodes(pairs: DataFrame) -> DataFrame:
    node = lambda s: F.struct(F.col(f"{s}d").alias("doc_id"), F.col(f"{s}l").alias("line"), F.col(f"{s}h").alias("thash")).alias(s)
    return pairs.groupBy("ad", "al", "ah", "bd", "bl", "bh").agg(F.max("more").alias("more")).select(node("a"), node("b"), "more")


def share_of(size: int) -> int:
    return max(1, size // SHOWN)


def list_parts(some: DataFrame, least: int, percent: int, rarity: np.ndarray, size: int) -> np.ndarray:
    """Into how many parts the list of each slot of ``rarity`` is split, by its words in the prefixes of ``some`` texts: one in ``share_of(size)``."""
    share, slots = share_of(size), len(rarity)
    shared = some.sparkSession.sparkContext.broadcast(rarity)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, level = np.zeros(slots, np.int32), setjoin.levels(shared.value)
        for b in batches:
            found = Lines(b.column(0), least)
            sets = setjoin.OrderedSets(found.owner, found.token, found.n, shared.value, percent, level)
            there = sets.in_prefix & joins(sets.size, percent)[sets.owner]
            total += np.bincount((sets.token[there] & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there], pa.int64())], ["slot", "n"])

    long = map_arrow(some, count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") * share > size).collect()
    parts = np.ones(slots, np.int32)
    for r in long:  # of fixed size: one number a slot at most
        parts[r.slot] = -(-r.n * share // size)
    return parts


def candidate_pairs(own: DataFrame, some: DataFrame, least: int, percent: int, rarity: np.ndarray, postings: int, few: int = FEW, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pairs, lists). Pairs (a struct, b struct, more) of lines by (doc_id, line, thash), so that rows that share an id are told
    apart by their text; a is later. Lists (token, postings) hold the words at which a line may have more partners: many
    whole lists a row where token is null, else a part of the split list of that word.

    ``postings``, the words in all prefixes, gives the number of blocks, so that a block's size does not grow with the input.
    """
    spark, n = own.sparkSession, max(partitions(own), postings // size + 1)
    shared = spark.sparkContext.broadcast(rarity)
    dealt_in = spark.sparkContext.broadcast(list_parts(some, least, percent, rarity, size))

    def parts_of(token: np.ndarray) -> np.ndarray:
        return dealt_in.value[(token & np.uint64(len(dealt_in.value) - 1)).astype(np.int64)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def out() -> pa.RecordBatch:
            one, two, doc, line, records, length = (np.concatenate([h[k] for h in held]) for k in range(6))
            held.clear()
            # of equal sets the earliest
            order = np.lexsort((line, doc, two, one))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
            keep = np.zeros(len(order), bool)
            keep[order[fresh]] = True
            which = np.flatnonzero(np.repeat(keep, length))
            token, parts = records["token"][which], parts_of(records["token"][which])
            block = ((token >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
            split = np.flatnonzero(parts > 1)
            part = mix64(records["key"][which[split]]) % parts[split].astype(np.uint64)
            block[split] = (((token[split] >> np.uint64(20)) + part) % np.uint64(n)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            # as rows of numbers, which numpy moves much faster than records
            block, records = block[order], np.take(records.view("<i4").reshape(-1, RECORD.itemsize // 4), which[order], 0).reshape(-1).view(RECORD)
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(cuts[1:], len(order))[: len(cuts)]
            packed = [squeeze(pack(records, slice(x, y))) for x, y in zip(cuts.tolist(), ends.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array(packed, pa.binary())], ["block", "postings"])

        level = setjoin.levels(shared.value)
        for b in batches:
            found = Lines(b.column(2), least)
            sets = setjoin.OrderedSets(found.owner, found.token, found.n, shared.value, percent, level)
            doc, text = (b.column(k).take(pa.array(found.doc)).to_numpy() for k in range(2))
            # a count of one means that no other line holds the token
            i = np.flatnonzero(sets.in_prefix & np.repeat(joins(sets.size, percent), sets.size))
            i = i[sets.counts(i) > 1]
            o = sets.owner[i]
            records = np.zeros(len(i), RECORD)
            maps = setjoin.bitmaps(sets, BITMAP).view("<u8")
            short = np.uint64((1 << SHORT) - 1)
            for name, value in (("token", sets.token[i] & short), ("key", sets.keys[0][o] & short), ("x", maps[o, 0]), ("y", maps[o, 1]), ("doc", doc[o]), ("hash", text[o]), ("line", found.line[o]), ("n", sets.size[o]), ("p", sets.place[i])):
                records[name] = value
            held.append((sets.keys[0], sets.keys[1], doc, found.line, records, np.bincount(o, minlength=found.n)))
            count += len(i)
            if count > FLUSH:
                yield out()
                count = 0
        if held:
            yield out()

    def answer(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows, a, b, full = candidates(unpack(held), percent, few)
        token = rows["token"]
        split = parts_of(token) > 1
        yield from _pairs(rows, a, b, full | split, 2)
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        length = np.diff(np.concatenate([starts, [len(token)]]))
        whole = np.repeat(np.add.reduceat(full & ~split, starts) > 0, length) if len(starts) else np.zeros(0, bool)
        if whole.any():
            yield _list(None, pack(rows, whole))
        for at, count in zip(starts[split[starts]].tolist(), length[split[starts]].tolist(), strict=True):
            yield _list(int(token[at : at + 1].view(np.int64)[0]), pack(rows, slice(at, at + count)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by block: one block is held at a time
        held: list[bytes] = []
        now = None
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != now and held:
                    yield from answer(held)
                    held = []
                now = block
                held.append(expand(raw.as_py()))
        if held:
            yield from answer(held)

    dealt = map_arrow(own, send, "block long, postings binary").repartition(partitions(own), "block").sortWithinPartitions("block")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    found = settle(dealt.mapInArrow(meet, f"{PAIR}, token long, postings binary"), "line-met")
    return _nodes(found.where("postings is null")), found.where("postings is not null").select("token", "postings")


def list_members(lists: DataFrame) -> DataFrame:
    """(doc_id, line, thash) of the lines in stored lists; rows may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows = unpack([raw.as_py()])
                yield pa.RecordBatch.from_arrays([pa.array(rows[c]) for c in ("doc", "line", "hash")], ["doc_id", "line", "thash"])

    lists.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    return lists.select("postings").mapInArrow(run, "doc_id long, line int, thash long")


def further_pairs(lists: DataFrame, rest: DataFrame, split_more: DataFrame, percent: int, size: int = BLOCK) -> DataFrame:
    """All pairs (a, b, more) of the stored lists whose a is one of the lines ``rest`` (or, rarely, another line), which seek.

    ``split_more`` (doc_id, line, thash) holds the lines that seek in split lists.
    """
    spark = lists.sparkSession
    shared = spark.sparkContext.broadcast((line_bits(rest), line_bits(split_more)))

    def seeking(rows: dict[str, np.ndarray], which: int) -> np.ndarray:
        return bits_hold(np.frombuffer(shared.value[which], np.uint8), _line_key(rows["doc"], rows["line"]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(1):
                rows = unpack([raw.as_py()])
                seeks = seeking(rows, 0)
                some = np.isin(rows["token"], rows["token"][seeks])
                if some.any():
                    rows, a, b, full = candidates({c: v[some] for c, v in rows.items()}, percent, None, seeks[some])
                    yield from _pairs(rows, a, b, full)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for token, raw, total in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                rows, cells = unpack([raw.as_py()]), -(-total // (size * WIDTH))
                cell = (mix64(rows["key"]) % np.uint64(cells)).astype(np.int64)
                seeks = seeking(rows, 1)
                asked = pack(rows, seeks)
                for k in range(cells):
                    mine = [(0, pack(rows, cell == k))] + ([(1, asked)] if asked else [])
                    yield pa.RecordBatch.from_arrays([pa.array([token] * len(mine), pa.int64()), pa.array([k] * len(mine), pa.int64()), pa.array([m[0] for m in mine], pa.int32()), pa.array([m[1] for m in mine], pa.binary())], ["token", "cell", "kind", "postings"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by cell and kind: one part of a list is held, and one run of seeking lines
        part: list[bytes] = []
        now = None
        for batch in batches:
            for token, cell, kind, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (token, cell) != now:
                    part, now = [], (token, cell)
                if kind == 0:
                    part.append(raw)
                    continue
                rows = unpack([*part, raw])
                seeks = np.zeros(len(rows["token"]), bool)
                seeks[len(seeks) - len(raw) // WIDTH :] = True
                rows, a, b, full = candidates(rows, percent, None, seeks)
                yield from _pairs(rows, a, b, full)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    few = lists.where("token is null").mapInArrow(whole, PAIR)
    split = lists.where("token is not null")
    totals = split.groupBy("token").agg(F.sum(F.length("postings")).alias("total"))
    cells = split.join(totals, "token").select("token", "postings", "total").mapInArrow(deal, "token long, cell long, kind int, postings binary")
    met = cells.repartition(partitions(lists), "token", "cell").sortWithinPartitions("token", "cell", "kind").mapInArrow(meet, PAIR)
    return _nodes(few.unionByName(met))


def _line_key(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix64(doc.astype(np.uint64)) + line.astype(np.uint64)


SET = [("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("line", "<i4"), ("hash", "<i8")]
BLOCKS = 1024  # of sets, at least


def repeated(sets: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(the earliest line of each set, the other lines). Lines at the earliest one's place are in neither: their rows are equal."""
    order = np.lexsort([sets[c] for c in (["hash"] if sets["hash"].any() else []) + ["line", "doc", "two", "one"]])
    sets = {c: v[order] for c, v in sets.items()}
    fresh = np.ones(len(order), bool)
    fresh[1:] = (sets["one"][1:] != sets["one"][:-1]) | (sets["two"][1:] != sets["two"][:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    later = np.zeros(len(order), bool)
    for c in ("doc", "line", "hash"):
        later |= sets[c] != sets[c][first]
    return {c: v[fresh] for c, v in sets.items()}, {c: v[later] for c, v in sets.items()}


def first_pass(own: DataFrame, least: int, percent: int, share: int) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray, int]:
    """(copies, texts, some, counts, postings): one pass over the texts.

    Copies (doc_id, thash, line) are the lines whose set an earlier line has. Each task finds its own and sends every set once, in
    blocks by key, so no block grows with a set that many lines have. Texts are (doc_id, thash, whole), some (text) those that a hash chooses, one in ``share``. The counts tell how often
    each word occurs, by its hash: a table of fixed size, summed by part. The prefixes of all lines hold ``postings`` words.
    """
    slots, parts, blocks = 1 << RARITY_BITS, 16, max(BLOCKS, partitions(own))
    kinds = {"doc_id": pa.int64(), "thash": pa.int64(), "line": pa.int32(), "whole": pa.int64(), "part": pa.int32(), "counts": pa.binary(), "postings": pa.int64(), "block": pa.int32(), "sets": pa.binary(), "text": pa.string()}

    def rows(n: int, **columns) -> pa.RecordBatch:  # type: ignore[no-untyped-def]
        given = {c: v if isinstance(v, pa.Array) else pa.array(v, kinds[c]) for c, v in columns.items()}
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, postings = np.zeros(slots, np.int32), 0
        held: list[list[np.ndarray]] = []
        count = 0

        def out() -> Iterator[pa.RecordBatch]:
            sets, later = repeated({name: np.concatenate([h[k] for h in held]) for k, (name, _) in enumerate(SET)})
            held.clear()
            yield rows(len(later["doc"]), doc_id=later["doc"], thash=later["hash"], line=later["line"])
            block = (sets["one"] % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            block, sets = block[order], {name: sets[name][order] for name, _ in SET}
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(cuts[1:], len(block))[: len(cuts)]
            packed = [b"".join(sets[name][x:y].tobytes() for name, _ in SET) for x, y in zip(cuts.tolist(), ends.tolist(), strict=True)]
            yield rows(len(cuts), block=block[cuts], sets=packed)

        for b in batches:
            found = Lines(b.column(2), least)
            total += np.bincount((found.token & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
            sets = setjoin.OrderedSets(found.owner, found.token, found.n, None)
            n = sets.size[joins(sets.size, percent)]
            postings += int((n - -(-n * percent // 100) + 1).sum())
            held.append([*sets.keys, b.column(0).to_numpy()[found.doc], found.line, b.column(1).to_numpy()[found.doc]])
            count += found.n
            yield rows(b.num_rows, doc_id=b.column(0), thash=b.column(1), whole=b.column(3))
            some = b.column(2).filter(b.column(4))
            yield rows(len(some), text=some)
            if count > FLUSH:
                yield from out()
                count = 0
        if held:
            yield from out()
        # byte by byte, which compresses better
        planes = [np.ascontiguousarray(p.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for p in total.reshape(parts, -1)]
        yield rows(parts, part=range(parts), counts=planes)
        yield rows(1, postings=[postings])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for part, planes in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                now = np.ascontiguousarray(np.frombuffer(planes.as_py(), np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)
                out[part] = out.get(part, np.zeros(len(now), np.int64)) + now
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in out.values()], pa.binary())], ["part", "counts"])

    def answer(held: list[bytes]) -> pa.RecordBatch:
        columns: dict[str, list[np.ndarray]] = {name: [] for name, _ in SET}
        for raw in held:
            n, at = len(raw) // sum(np.dtype(kind).itemsize for _, kind in SET), 0
            for name, kind in SET:
                columns[name].append(np.frombuffer(raw, kind, n, at))
                at += columns[name][-1].nbytes
        later = repeated({name: np.concatenate(v) for name, v in columns.items()})[1]
        return pa.RecordBatch.from_arrays([pa.array(later[c]) for c in ("doc", "hash", "line")], ["doc_id", "thash", "line"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by block: one block is held at a time
        held: list[bytes] = []
        now = None
        for batch in batches:
            for block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now and held:
                    yield answer(held)
                    held = []
                now = block
                held.append(raw)
        if held:
            yield answer(held)

    spark = own.sparkSession
    own = own.select("doc_id", "thash", "text", "whole", (F.pmod(F.xxhash64("thash", "doc_id"), F.lit(share)) == 0).alias("some"))
    found = settle(map_arrow(own, read, "doc_id long, thash long, line int, whole long, part int, counts binary, postings long, block int, sets binary, text string"), "line-keys")
    counts = np.zeros((parts, slots // parts), np.int64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    for r in found.where("part is not null").select("part", "counts").repartition(parts, "part").mapInArrow(add, "part int, counts binary").collect():
        counts[r.part] += np.frombuffer(bytes(r.counts), "<i8")
    postings = found.agg(F.sum("postings")).first()[0] or 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    dealt = found.where("block is not null").select("block", "sets").repartition(partitions(own), "block").sortWithinPartitions("block")
    place = ["doc_id", "thash", "line"]
    met = settle(dealt.mapInArrow(meet, "doc_id long, thash long, line int"), "line-copies")
    copies = found.where("line is not null").select(place).unionByName(met)
    return copies, found.where("whole is not null").select("doc_id", "thash", "whole"), found.where("text is not null").select("text"), counts.reshape(-1), postings


def told_apart(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, thash, text, whole) of the rows with an id and a text, and whether no id repeats. whole is the text's hash, and
    so is thash where another row may have the same id; it is 0 where the id suffices, which spares eight bytes a posting."""
    # the ids alone: rows without a text count too
    again = settle(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "line-again")
    own = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("whole"))
    unique = again.isEmpty()
    tag = F.lit(0) if unique else F.when(key_filter(again, "doc_id")(F.col("doc_id")), F.col("whole")).otherwise(F.lit(0))
    return own.select("doc_id", tag.cast("long").alias("thash"), "text", "whole"), unique


def removed_lines(docs: DataFrame, least: int = LEAST, percent: int = setjoin.PERCENT, few: int = FEW, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """(doc_id, thash, lines): numbers, from 0, of the lines to remove from the text with that xxhash64."""
    own, unique = told_apart(documents(docs, id_col, text_col))
    copies, whole, some, rarity, postings = first_pass(own, least, percent, share_of(size))
    own = own.drop("whole")

    def matched(pairs: DataFrame) -> DataFrame:
        """(doc_id, line, thash) of the pairs' later lines that are similar to the earlier one."""
        lines = pairs.select("a.*").union(pairs.select("b.*"))
        size = min(max(1 << (8 * pairs.count()).bit_length(), BLOOM_BITS), MOST_BITS)
        wanted = own.sparkSession.sparkContext.broadcast(line_bits(lines, size))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # the set may hold other lines too, which meet no pair
            bits = np.frombuffer(wanted.value, np.uint8)
            for b in batches:
                raw, doc, line, begin, end = line_places(b.column(2))
                hit = bits_hold(bits, _line_key(b.column(0).to_numpy()[doc], line))
                doc, line = doc[hit], line[hit]
                texts = [raw[x:y] for x, y in zip(begin[hit].tolist(), end[hit].tolist(), strict=True)]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(line), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "thash", "line", "text"])

        texts = map_arrow(own, cut, "doc_id long, thash long, line int, text string").select(F.struct("doc_id", "line", "thash").alias("node"), "text")
        texts = settle(texts if unique else texts.distinct(), "line-texts")
        similar = setjoin.verified(pairs, texts, _line_sets, percent)
        return similar.select("a.*").distinct()

    pairs, lists = candidate_pairs(own, some, least, percent, rarity, postings, few, size)
    pairs = settle(pairs, "line-pairs")
    hits = settle(matched(pairs), "line-matched")
    rest = settle(pairs.where("more").select("a.*").distinct().join(hits, ["doc_id", "line", "thash"], "left_anti"), "line-rest")
    # in split lists every line without a match seeks, whether it met a partner in its own part or not
    split = settle(list_members(lists.where("token is not null")).distinct().join(hits, ["doc_id", "line", "thash"], "left_anti"), "line-split")
    if not lists.isEmpty():
        done = hits.select(F.struct("doc_id", "line", "thash").alias("a"))
        others = further_pairs(lists, rest, split, percent, size).select("a", "b").join(done, "a", "left_anti").join(pairs.select("a", "b"), ["a", "b"], "left_anti")
        hits = hits.unionByName(matched(settle(others, "line-pairs")))

    # Every line that matched, and of equal sets all but the earliest.
    gone = copies.unionByName(hits.select("doc_id", "thash", "line")).groupBy("doc_id", "thash").agg(F.collect_set("line").alias("lines"))
    return gone.join(whole.distinct(), ["doc_id", "thash"]).select("doc_id", F.col("whole").alias("thash"), "lines")


def line_places(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, doc, line, begin, end) of all lines of texts."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else b""
    doc, line, begin = line_starts(np.frombuffer(raw, np.uint8), offsets - offsets[0])
    # a line ends before the feed in front of the next one, or with its text
    end = np.append(begin[1:] - 1, 0)
    last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
    end[: len(doc)][last] = (offsets - offsets[0])[1:]
    return raw, doc, line, begin, end[: len(doc)]


def _line_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Words of texts that are one line each."""
    words = Words(texts, lower=True)
    return np.repeat(np.arange(len(texts)), words.counts()), words.hashes(), len(texts)


def line_bits(lines: DataFrame, size: int = BLOOM_BITS) -> bytes:
    """A bit set of lines."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for b in batches:
            bits_add(bits, _line_key(b.column(0).to_numpy(), b.column(1).to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOOM_PARTS), pa.int32()), pa.array([p.tobytes() for p in bits.reshape(BLOOM_PARTS, -1)], pa.binary())], ["part", "bits"])

    lines.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    return either_bits(lines.select("doc_id", "line").mapInArrow(build, "part int, bits binary"), size).tobytes()


def drop_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text", number_col: str | None = None) -> DataFrame:
    """``docs`` without the lines; ``number_col`` adds how many went. All other columns stay as they are."""
    i, h, gone_lines, maybe = unused(docs, "id", "thash", "lines", "may", *([number_col] if number_col else []))[:4]
    removed = settle(removed, "line-removed").select(F.col("doc_id").alias(i), F.col("thash").alias(h), F.col("lines").alias(gone_lines))
    may = key_filter(removed, h)

    def one(text: str | None, gone) -> str | None:  # type: ignore[no-untyped-def]
        if text is None or gone is None:
            return text
        drop = set(map(int, gone))
        return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)

    @F.pandas_udf("string")
    def rest(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lines in parts:
            yield pd.Series([one(t, g) for t, g in zip(texts, lines, strict=True)], dtype=object)
        give_back()

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    text, empty = F.col(text_col).cast("string"), F.lit(None).cast("array<int>")
    marked = docs.withColumn(maybe, text.isNotNull() & may(F.xxhash64(text)))
    alone = marked.where(~F.col(maybe)).withColumn(gone_lines, empty)
    met = marked.where(F.col(maybe)).join(removed, (F.col(id_col).cast("long") == F.col(i)) & (F.xxhash64(text) == F.col(h)), "left").drop(i, h)
    met = met.withColumn(text_col, F.when(F.col(gone_lines).isNull(), text).otherwise(rest(text, F.col(gone_lines))))
    out = alone.unionByName(met)
    if number_col:
        out = out.withColumn(number_col, F.coalesce(F.size(gone_lines), F.lit(0)).cast("long"))
    return out.drop(maybe, gone_lines)


def dedup_lines(docs: DataFrame, least: int = LEAST, percent: int = setjoin.PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return drop_lines(docs, removed_lines(docs, least, percent, id_col=id_col, text_col=text_col), id_col, text_col)
