"""Substring dedup: repeated word windows by prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one document; it is a repeat if the same words also start in a document with
a smaller id. Every word that a repeat covers is removed; windows are judged on the input.

1. Suffixes are sampled by content: of the word sequences of length ``prefix`` that start in a window, those with the
   least hash. Equal windows thus hold equal samples, and a window repeats only if its sample's prefix occurs in two
   documents. Samples whose prefix occurs in one document alone are dropped.
2. A remaining sample stands for the segment of words that windows around it can reach. Equal segments are
   collapsed: all documents but the smallest repeat that segment whole.
3. Distinct segments go to the group of their prefix. Groups of at most ``group`` segments are sorted into suffix
   trees, many groups of a task at once, by doubling the depth: at each depth suffixes whose path occurs in one document
   alone are left out, and the nodes at the depth of a window give the repeats, with the smallest document of each node.
4. A larger group is split by longer prefixes, to the right or to the left of the sample. Where even those are shared by
   too many segments, whole windows are the prefixes: such a node needs its smallest document only, which partial
   aggregation finds however large the group is.

Null texts have no words. Documents with a null id are never removed from and remove nothing. Rows that repeat an id are
one document as to the order of ids: they do not remove each other's words. Texts with fewer words than a window
stay whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import documents, key_filter, map_arrow, mix64, partitions
from tidewatch.llm.words import Words, grams, ranges_hash
from tidewatch.session import settle

WINDOW = 50
PREFIX = 10
GROUP = 16_384  # segments of one prefix that one tree may hold: some 100 MB while it is sorted
CHUNK = 4_096  # segments sorted at once
CROWDS = 100_000  # nodes whose smallest document is looked up, at most 24 bytes each
_NEVER = np.uint64(2**64 - 1)


def sampled(hashes: np.ndarray, first: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sampled suffixes in a batch's words, and the hash of the prefix at each place."""
    n, reach = len(hashes), window - prefix + 1
    value = np.full(n, _NEVER)
    own = grams(hashes, prefix)
    value[: len(own)] = own
    end = np.repeat(first[1:], np.diff(first))
    place = np.arange(n)
    value[place + prefix > end] = _NEVER

    def slide(x: np.ndarray, pick, fill, back: bool) -> np.ndarray:  # type: ignore[no-untyped-def]
        """pick over ``reach`` neighbours from each place on, or up to it."""

        def moved(y: np.ndarray, by: int) -> np.ndarray:
            out = np.full(n, fill, np.uint64)
            if by < n:
                if back:
                    out[by:] = y[: n - by]
                else:
                    out[: n - by] = y[by:]
            return out

        width = 1
        while 2 * width <= reach:
            x = pick(x, moved(x, width))
            width *= 2
        return pick(x, moved(x, reach - width)) if reach > width else x

    least = slide(value, np.minimum, _NEVER, False)
    least[place + window > end] = 0  # no window starts here
    chosen = np.flatnonzero((slide(least, np.maximum, 0, True) == value) & (value != _NEVER))
    return chosen, value


def _bounds(place: np.ndarray, first: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, begin and end of the segment around each sampled place."""
    doc = np.searchsorted(first, place, "right") - 1
    return doc, np.maximum(first[doc], place - (window - prefix)), np.minimum(first[doc + 1], place + window)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def samples(own: DataFrame, window: int, prefix: int) -> DataFrame:
    """(doc_id, thash, prefix, seg, pos) of every sampled suffix; seg is the hash of the segment around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = Words(b.column(2))
            h = words.hashes()
            place, value = sampled(h, words.first, window, prefix)
            doc, begin, end = _bounds(place, words.first, window, prefix)
            seg = mix64(ranges_hash(h, begin, end) + (place - begin).astype(np.uint64))
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(_signed(value[place])), pa.array(_signed(seg)), pa.array((place - words.first[doc]).astype(np.int32))],
                ["doc_id", "thash", "prefix", "seg", "pos"],
            )

    return map_arrow(own, run, "doc_id long, thash long, prefix long, seg long, pos int")


def _with_places(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text, places) of the documents in ``wanted``; only those are shuffled, as far as a bit set tells."""
    places = wanted.groupBy("doc_id", "thash").agg(F.collect_list(F.struct("prefix", "seg", "pos")).alias("places"))
    may = key_filter(wanted, "thash")
    return own.where(may(F.col("thash"))).join(places, ["doc_id", "thash"]).select("doc_id", "text", "places")


def _located(b: pa.RecordBatch, window: int, prefix: int) -> tuple:
    """Words' hashes and, for each wanted place, its document, keys, place and bounds."""
    words = Words(b.column(1))
    h = words.hashes()
    lists = b.column(2)
    doc = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
    flat = lists.flatten()
    place = np.asarray(flat.field("pos")).astype(np.int64) + words.first[doc]
    _, begin, end = _bounds(place, words.first, window, prefix)
    return h, b.column(0).take(pa.array(doc)), flat.field("prefix"), flat.field("seg"), place, begin, end


def repeats(docs: np.ndarray, left: np.ndarray, words: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix trees of many segments: for each the first and last start of a repeated window, relative to its sample.

    ``last < first`` where there is none. The doubled depths are the levels of the trees; nodes at the depth of a
    window with two documents or more are the deep internal ones.
    """
    n = len(words)
    size = np.array([len(w) for w in words], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(words) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    room = begin[owner + 1] - np.arange(len(flat))
    doc = docs[owner]
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)

    def level(alive: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the suffixes ``alive``: those whose node has two documents, the node's number, its smallest document."""
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])) if len(key) else np.zeros(0, np.int64)
        if not len(starts):
            return alive, key, key
        owners = doc[alive[order]]
        least, most = np.minimum.reduceat(owners, starts), np.maximum.reduceat(owners, starts)
        node = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(key)]])))
        keep = (least < most)[node]
        return alive[order][keep], node[keep], least[node[keep]]

    name = np.full(len(flat), -1, np.int64)
    alive, node, least = level(np.arange(len(flat)), flat)
    name[alive] = node
    depth = 1
    while depth < window:
        step = min(depth, window - depth)
        alive = alive[room[alive] >= depth + step]
        alive = alive[name[alive + step] >= 0]
        key = name[alive] * (len(flat) + 1) + name[alive + step]
        alive, node, least = level(alive, key)
        name = np.full(len(flat), -1, np.int64)
        name[alive] = node
        depth += step
    hit = alive[doc[alive] > least] if len(alive) else alive
    at = hit - begin[owner[hit]] - left[owner[hit]]
    np.minimum.at(low, owner[hit], at)
    np.maximum.at(high, owner[hit], at)
    return low, high


FOUND = "prefix long, seg long, doc_id long, full_from int, full_to int, `from` int, `to` int"
SLICES = "prefix long, seg long, doc_id long, full_from int, full_to int, key long, left int, words binary"


def _trees(slices: DataFrame, window: int, chunk: int) -> DataFrame:
    """FOUND for slices of segments that are dealt and sorted by key; from and to are null without a repeat."""
    names = ["prefix", "seg", "doc_id", "full_from", "full_to"]

    def solve(rows: pa.Table) -> pa.RecordBatch:
        left = rows["left"].to_numpy().astype(np.int64)
        low, high = repeats(rows["doc_id"].to_numpy(), left, [np.frombuffer(w, "<u8") for w in rows["words"].to_pylist()], window)
        none = high < low
        ends = [pa.array(np.where(none, 0, x).astype(np.int32), mask=none) for x in (low, np.where(none, 0, high) + window)]
        return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in names), *ends], [*names, "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            count += b.num_rows
            if count >= chunk:  # all whole keys but the last, which may go on
                rows = pa.Table.from_batches(held)
                keys = rows["key"].to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield solve(rows.slice(0, cut))
                    held = rows.slice(cut).combine_chunks().to_batches()
                    count = len(rows) - cut
        if held:
            yield solve(pa.Table.from_batches(held))

    return map_arrow(slices, run, FOUND)


def _slices(own: DataFrame, wanted: DataFrame, window: int, prefix: int, longer: bool) -> DataFrame:
    """SLICES of the wanted segments: each whole under its prefix, or in two parts under longer prefixes.

    The windows that begin up to ``half`` words before the sample hold the ``window - half`` words from it on;
    the others hold ``half + 1`` words before it and its prefix.
    """
    half = (window - prefix) // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h, doc, keys, seg, place, begin, end = _located(b, window, prefix)
            every = np.arange(len(place))
            if longer:
                right = np.flatnonzero(place + window - half <= end)
                left = np.flatnonzero(place - half - 1 >= begin)
                row = np.concatenate([right, left])
                x = np.concatenate([np.maximum(begin, place - half)[right], begin[left]])
                y = np.concatenate([end[right], np.minimum(end, place + window - half - 1)[left]])
                key = np.concatenate([ranges_hash(h, place[right], place[right] + window - half), ~ranges_hash(h, place[left] - half - 1, place[left] + prefix)])
                keep = y - x >= window
                row, x, y, key = row[keep], x[keep], y[keep], _signed(key[keep])
            else:
                row, x, y, key = every, begin, end, keys.to_numpy(zero_copy_only=False)
            take = pa.array(row)
            words = [h[i:j].astype("<u8").tobytes() for i, j in zip(x.tolist(), y.tolist(), strict=True)]
            bounds = [pa.array(z.astype(np.int32)) for z in ((begin - place)[row], (end - place)[row])]
            yield pa.RecordBatch.from_arrays(
                [keys.take(take), seg.take(take), doc.take(take), *bounds, pa.array(key, pa.int64()), pa.array((place[row] - x).astype(np.int32)), pa.array(words, pa.binary())],
                ["prefix", "seg", "doc_id", "full_from", "full_to", "key", "left", "words"],
            )

    return map_arrow(_with_places(own, wanted), cut, SLICES)


def _whole_windows(slices: DataFrame, window: int, group: int) -> DataFrame:
    """FOUND by windows as prefixes: of each node only the smallest document is needed.

    Nodes of at most ``group`` windows are sorted; the smallest documents of larger ones, of which there are few, are
    found by partial aggregation and looked up.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words = [np.frombuffer(w, "<u8") for w in b.column(7).to_pylist()]
            h = np.concatenate(words)
            size = np.array([len(w) for w in words])
            count = size - window + 1
            row = np.repeat(np.arange(len(words)), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = (np.cumsum(size) - size)[row] + at
            one = ranges_hash(h, start, start + window)
            two = ranges_hash(mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start, start + window)
            relative = at - b.column(6).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(row)) for k in range(5)), pa.array(relative.astype(np.int32)), pa.array(_signed(one)), pa.array(_signed(two))], ["prefix", "seg", "doc_id", "full_from", "full_to", "at", "one", "two"])

    kinds = "prefix long, seg long, doc_id long, full_from int, full_to int, at int, one long, two long"
    windows = settle(map_arrow(slices, explode, kinds), "substring-windows")
    crowds = settle(windows.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")).where(F.col("m") > group).select("one", "two", "least"), "substring-crowds")
    if crowds.limit(CROWDS + 1).count() > CROWDS:
        known = windows.join(crowds, ["one", "two"], "left")
    else:
        found = {(r.one, r.two): r.least for r in crowds.collect()}

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                least = [found.get(k) for k in zip(b.column(6).to_pylist(), b.column(7).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], [*b.schema.names, "least"])

        known = settle(map_arrow(windows, look_up, kinds + ", least long"), "substring-known")
    quiet = known.where("least is null").withColumn("least", F.min("doc_id").over(Window.partitionBy("one", "two")))
    hit = F.when(F.col("doc_id") > F.col("least"), F.col("at"))
    return known.where("least is not null").unionByName(quiet).groupBy("prefix", "seg").agg(*(F.min(c).alias(c) for c in ("doc_id", "full_from", "full_to")), F.min(hit).alias("from"), (F.max(hit) + window).cast("int").alias("to"))


def segment_repeats(own: DataFrame, wanted: DataFrame, hot: DataFrame, window: int, prefix: int, group: int, chunk: int) -> DataFrame:
    """For each distinct segment the words of it that smaller documents repeat, as a stored table."""

    def grown(slices: DataFrame) -> DataFrame:
        return _trees(slices.repartition(partitions(own), "key").sortWithinPartitions("key"), window, chunk)

    out = settle(grown(_slices(own, wanted.join(hot, "prefix", "left_anti"), window, prefix, False)), "substring-trees")
    if not hot.limit(1).count():
        return out
    longer = settle(_slices(own, wanted.join(hot, "prefix", "left_semi"), window, prefix, True), "substring-longer")
    crowded = settle(longer.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > group).select("key"), "substring-crowded")
    found = grown(longer.join(crowded, "key", "left_anti"))
    if crowded.limit(1).count():
        found = found.unionByName(_whole_windows(longer.join(crowded, "key", "left_semi").select(*longer.columns), window, group))
    parts = found.groupBy("prefix", "seg").agg(*(F.min(c).alias(c) for c in ("doc_id", "full_from")), F.max("full_to").alias("full_to"), F.min("from").alias("from"), F.max("to").alias("to"))
    return settle(out.unionByName(parts), "substring-segments")


def repeated_spans(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, thash, spans): word spans, end exclusive and possibly overlapping, that repeat smaller documents.

    thash is xxhash64 of the text; it tells rows apart that share an id.
    """
    if not 0 < prefix <= window:
        raise ValueError("the prefix lies within the window")
    own = documents(docs, id_col, text_col).where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("thash"), "text")
    every = settle(samples(own, window, prefix), "substring-samples")
    twice = every.groupBy("prefix").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("prefix")
    twice = settle(twice, "substring-prefixes")
    may = key_filter(twice, "prefix")
    kept = settle(every.where(may(F.col("prefix"))).join(twice, "prefix"), "substring-kept")
    distinct = kept.groupBy("prefix", "seg").agg(F.min(F.struct("doc_id", "thash", "pos")).alias("first")).select("prefix", "seg", "first.*")
    distinct = settle(distinct, "substring-distinct")
    hot = settle(distinct.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > group).select("prefix"), "substring-hot")
    found = segment_repeats(own, distinct, hot, window, prefix, group, chunk).withColumnRenamed("doc_id", "smallest")
    whole = F.col("doc_id") > F.col("smallest")
    spans = kept.join(found, ["prefix", "seg"]).select(
        "doc_id",
        "thash",
        (F.col("pos") + F.when(whole, F.col("full_from")).otherwise(F.col("from"))).alias("begin"),
        (F.col("pos") + F.when(whole, F.col("full_to")).otherwise(F.col("to"))).alias("end"),
    )
    return spans.where("begin is not null").groupBy("doc_id", "thash").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words outside the spans, joined by one space."""
    own = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("thash"), "text")
    spans = settle(spans, "substring-spans")
    may = key_filter(spans, "thash")
    marked = own.withColumn("__may", F.col("text").isNotNull() & may(F.col("thash")))
    empty = F.lit(None).cast("array<struct<begin:int,end:int>>").alias("spans")
    rows = marked.where(~F.col("__may")).select("doc_id", "text", empty).unionByName(marked.where("__may").join(spans, ["doc_id", "thash"], "left").select("doc_id", "text", "spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, own_spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                n_words.append(len(words))
                at = gone = 0
                out: list[bytes] = []
                for s in sorted(own_spans or (), key=lambda s: s["begin"]):
                    if s["end"] > at:
                        out += words[at : max(at, s["begin"])]
                        gone += s["end"] - max(at, s["begin"])
                        at = s["end"]
                n_removed.append(gone)
                kept.append(b" ".join(out + words[at:] if at else words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip((n_words, n_removed, kept), schema.types[1:], strict=True))], schema=schema)

    return map_arrow(rows, run, "doc_id long, n_words long, n_removed long, text string")
