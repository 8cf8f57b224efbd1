"""Best-fit packing of token sequences: best-fit decreasing with a segment tree over remaining capacities.

Documents become token ids followed by a separator, are cut only where they exceed the capacity, and the pieces are
packed into as few sequences as possible. The pieces are dealt evenly over groups of ``group`` pieces, whatever
their documents, so a task packs a bounded number of pieces however skewed the input is; each group is packed from
its longest piece to its shortest. Bins that a group could not fill are opened again and packed together in
a second round, so the loss does not grow with the number of groups.

Null texts are empty texts: one separator. Repeated rows are separate documents. An empty table gives no rows. A
null document id is kept as null. Very long texts become many full pieces and one rest.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import documents, forget, map_arrow, process_cache, unknown
from tidewatch.session import settle

CAPACITY = 2048
GROUP = 8192
CACHE_WORDS = 300_000  # ids of so many words are remembered, then half or more are forgotten
IDLE_WORDS = 50_000  # words that a worker remembers between tasks, when several may idle beside a busy one
TEXTS = 64  # texts that are parted into words at once
SIGNS = rb"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""


class RoomTree:
    """Segment tree over remaining capacities 0..capacity; each leaf holds the open bins with that room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.any = bytearray(2 * self.size)

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        node = self.size + room
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def tightest(self, need: int) -> int:
        """The smallest room of an open bin that is at least ``need``, or -1."""
        node = self.size + need
        if self.any[node]:
            return need
        while node > 1:
            if not node & 1 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1

    def take(self, room: int) -> int:
        bin_id = self.bins[room].pop()
        if not self.bins[room]:
            node = self.size + room
            self.any[node] = 0
            node >>= 1
            while node:
                self.any[node] = self.any[2 * node] | self.any[2 * node + 1]
                node >>= 1
        return bin_id


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the room left in each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, left = RoomTree(capacity), []
    for i in order.tolist():
        need = int(lengths[i])
        room = tree.tightest(need)
        if room < 0:
            bin_id, room = len(left), capacity
            left.append(capacity)
        else:
            bin_id = tree.take(room)
        bins[i], offsets[i] = bin_id, capacity - room
        left[bin_id] = room - need
        tree.add(room - need, bin_id)
    return bins, offsets, np.array(left, np.int64)


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` with sequence_id long and offset long; every length must lie in 0..capacity."""
    if group < 2:
        raise ValueError("a group holds two pieces or more")
    names = pieces.columns
    taken = {"__group", "__bin", "__at", "__room"} & set(names)
    if taken or "sequence_id" in names or "offset" in names:
        raise ValueError(f"rename these columns first: {sorted(taken | ({'sequence_id', 'offset'} & set(names)))}")

    def round_of(df: DataFrame, groups: int) -> DataFrame:
        dealt = df.withColumn("__group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            bins, at, left = best_fit_decreasing(pdf[length_col].to_numpy(np.int64), capacity)
            return pdf.assign(__bin=bins, __at=at, __room=left[bins])

        return dealt.groupBy("__group").applyInPandas(one, f"{kinds}, __group long, __bin long, __at long, __room long")

    n = pieces.count()
    groups = -(-max(n, 1) // group)
    first = settle(round_of(pieces, groups), "packed")
    if groups == 1:
        return first.select(*names, (F.shiftleft(F.col("__group"), 24) + F.col("__bin")).alias("sequence_id"), F.col("__at").alias("offset"))
    # Second round: what lies in bins with much room left, packed anew together.
    poor = F.col("__room") > capacity // 64
    rest = first.where(poor).select(*names)
    again = round_of(rest, -(-max(rest.count(), 1) // group))
    done = first.where(~poor).withColumn("__group", 2 * F.col("__group")).unionByName(again.withColumn("__group", 2 * F.col("__group") + 1))
    return done.select(*names, (F.shiftleft(F.col("__group"), 24) + F.col("__bin")).alias("sequence_id"), F.col("__at").alias("offset"))


class WordEncoder:
    """Ids of single words by the tokenizers library, remembered by the Python worker.

    Words of letters only are one word to the tokenizer, so many are encoded as one text and parted at the
    tokens that end a word; ASCII signs after letters are words of their own. All else is encoded alone.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        held = process_cache(f"words of {tokenizer_file}")
        if "tokenizer" not in held:
            held["tokenizer"] = Tokenizer.from_file(tokenizer_file)
            vocab = held["tokenizer"].get_vocab()
            held["ends"] = np.zeros(max(vocab.values()) + 1, bool)
            held["ends"][[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.tokenizer, self.ends = held["tokenizer"], held["ends"]
        self.held, self.known = held, held.setdefault("known", {})
        held.setdefault("again", set())

    def words(self, text: str) -> list[bytes]:
        """Words between ASCII white space, ASCII letters in lower case (the tokenizer does so itself)."""
        raw = text.encode()
        return (raw if b"<|" in raw else raw.lower()).split()

    def learn(self, words: set[bytes]) -> None:
        known = self.known
        new = unknown(words, self.held, CACHE_WORDS)
        # letters before ASCII signs: the tokenizer parts there
        bodies = [(w, w.rstrip(SIGNS)) for w in new if w[-1] in SIGNS]
        letters, rest, marked = [], [], []
        if bodies:
            texts = b" ".join([b for _, b in bodies]).decode().split(" ")
            marked = [(w, b) for (w, b), t in zip(bodies, texts, strict=True) if t.isalpha() and t.lower().isalpha()]
        plain = list(new)
        if marked:
            parts = new.difference([w for w, _ in marked]).union([b for _, b in marked], [w[len(b) :] for w, b in marked])
            plain = [w for w in parts if w not in known]
        texts = b" ".join(plain).decode().split(" ") if plain else []
        for w, text in zip(plain, texts, strict=True):
            (letters if text.isalpha() and (text.isascii() or text.lower().isalpha()) else rest).append((w, text))
        for at in range(0, len(letters), 2000):
            part = letters[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([t for _, t in part])], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) != len(part):
                rest += part
                continue
            raw = ids.tobytes()
            for (w, _), begin, stop in zip(part, [0, *stops[:-1]], stops, strict=True):
                known[w] = raw[begin:stop]
        for at in range(0, len(rest), 2000):
            part = rest[at : at + 2000]
            for (w, _), e in zip(part, self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()
        for w, b in marked:
            known[w] = known[b] + known[w[len(b) :]]

    def rest(self) -> None:
        """Called at a task's end."""
        if len(self.known) > IDLE_WORDS:
            forget(self.held, IDLE_WORDS)


def pieces_of(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids): token ids as unsigned little-endian 32-bit binary, cut at ``capacity``.

    The tokenizer must not look across ASCII white space, which holds for tokenizers that drop it: words are
    encoded once per task by the tokenizers library and remembered.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    end = separator.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_file)
        known = encoder.known
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            size = 0
            # few texts at a time: what stays of their words would else lie scattered among very many that go
            for at in range(0, batch.num_rows, TEXTS):
                few = batch.slice(at, TEXTS)
                texts = [encoder.words(t or "") for t in few.column(1).to_pylist()]
                encoder.learn(set().union(*texts))
                for doc_id, words in zip(few.column(0).to_pylist(), texts, strict=True):
                    ids = b"".join([*map(known.__getitem__, words), end])
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[start : start + 4 * capacity]
                        for column, value in zip(out, (doc_id, k, start // 4, len(piece) // 4, piece), strict=True):
                            column.append(value)
                    size += len(ids)
                    if size > 32_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)
                        out, size = [[], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)
        encoder.rest()

    return map_arrow(documents(docs, id_col, text_col), cut, "doc_id long, piece int, start long, length long, ids binary")


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    cut = pieces_of(docs, tokenizer_file, id_col, text_col, capacity)
    return pack(settle(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"), "length", capacity)
