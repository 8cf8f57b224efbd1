"""Byte-level BPE encoding and decoding: batched merge rounds in numpy.

The pieces of a batch's words that are not known yet are laid in one flat array of symbols. Each neighbouring pair's rank
is found in a hash table, by binary search over the sorted pair keys where a slot has several. In each round each word's lowest
rank is merged wherever it occurs in the word (from the left where two places overlap), the pairs of merged symbols are
ranked anew, and words without a mergeable pair leave.

Null texts are empty texts: no ids, and decoded they are empty. Strings of added tokens in a text become their id, as
the tokenizers library does by default. Ids that are not in the vocabulary decode to nothing; bytes that are
not UTF-8 decode to U+FFFD. Repeated rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import documents, map_arrow, process_cache

#: Fixed value: the split of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 500_000
SLOT_BITS = 18


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _parted(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable, else the next from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    fresh = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(fresh)) for b in range(256)]


class BytePairs:
    """Vocabulary and sorted pair keys of a byte-level tokenizer file."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        letters = byte_letters()
        self.symbol = np.array([vocab[x] for x in letters], np.int64)
        self.width = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        # the place of each slot's key; -1 where it has none, -2 where it has several
        slot = _slot(self.keys)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int64)
        self.slots[slot] = np.arange(len(slot))
        self.slots[np.bincount(slot, minlength=len(self.slots)) > 1] = -2
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        value = {x: b for b, x in enumerate(letters)}
        self.bytes = [b""] * self.width
        for token, i in vocab.items():
            self.bytes[i] = bytes(value[x] for x in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; the number of merges where it has none."""
        key = left * self.width + right
        at = self.slots[_slot(key)]
        several = np.flatnonzero(at == -2)
        at[several] = np.minimum(np.searchsorted(self.keys, key[several]), len(self.keys) - 1)
        return np.where((at >= 0) & (self.keys[at] == key), self.rank[at], len(self.merged))

    def encode_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each word has."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.symbol[np.frombuffer(b"".join(words), np.uint8)]
        owners = np.repeat(np.arange(len(words)), sizes)
        owner, place = owners, np.arange(len(symbols))
        out = np.full(len(symbols), -1, np.int64)  # where each symbol of a finished word begins
        none = len(self.merged)
        # the last symbol of a word opens no pair; a rank of ``none`` stands there
        rank = np.full(len(symbols), none)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            length = np.diff(starts, append=len(symbols))
            best = np.minimum.reduceat(rank, starts)
            over = best == none
            if over.any():
                gone = np.repeat(over, length)
                out[place[gone]] = symbols[gone]
                symbols, owner, place, rank = (x[~gone] for x in (symbols, owner, place, rank))
                if not len(symbols):
                    break
                best, length = best[~over], length[~over]
            hit = rank == np.repeat(best, length)
            # of pairs that overlap, every second one from the left
            begin = hit & ~np.concatenate([[False], hit[:-1]])
            run = np.maximum.accumulate(np.where(begin, np.arange(len(hit)), 0))
            hit &= (np.arange(len(hit)) - run) % 2 == 0
            left = np.flatnonzero(hit)
            symbols[left] = self.merged[rank[left]]
            stay = np.ones(len(symbols), bool)
            stay[left + 1] = False
            symbols, owner, place, rank = (x[stay] for x in (symbols, owner, place, rank))
            # only pairs with a merged symbol have a new rank
            new = left - np.arange(len(left))
            new = np.concatenate([new, new[new > 0] - 1])
            rank[new] = none
            new = new[new + 1 < len(symbols)]
            new = new[owner[new] == owner[new + 1]]
            rank[new] = self.ranks(symbols[new], symbols[new + 1])
        there = out >= 0
        return out[there], np.bincount(owners[there], minlength=len(words))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit binary."""
        return _parted(*self.encode_flat(words))

    def pieces(self, text: str) -> list[str | int]:
        """The text's words, with the ids of added tokens between them."""
        if self.special is None or not any(t in text for t in self.added):
            return self.split.findall(text)
        out: list[str | int] = []
        at = 0
        for m in self.special.finditer(text):
            out += self.split.findall(text[at : m.start()])
            out.append(self.added[m.group()])
            at = m.end()
        return out + self.split.findall(text[at:])


def encode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = process_cache(f"pairs of {tokenizer_file}")
        pairs = held.setdefault("pairs", None) or BytePairs(tokenizer_file)
        held["pairs"], known = pairs, held.setdefault("known", {})
        for batch in batches:
            texts = [pairs.pieces(t or "") for t in batch.column(1).to_pylist()]
            if len(known) > CACHE_WORDS:
                known.clear()
            new = [w for w in set().union(*texts) if w not in known]
            special = [w for w in new if isinstance(w, int)]
            known.update((w, np.array([w], "<u4").tobytes()) for w in special)
            if special:
                new = [w for w in new if not isinstance(w, int)]
            known.update(zip(new, pairs.encode_words([w.encode() for w in new]), strict=True))
            ids = [b"".join(map(known.__getitem__, words)) for words in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], schema=schema)

    return map_arrow(documents(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text): the ids' bytes read as UTF-8; null ids decode to an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = process_cache(f"bytes of {tokenizer_file}")
        if not held:
            pieces = BytePairs(tokenizer_file).bytes
            held["size"] = np.array([len(x) for x in pieces], np.int64)
            held["bytes"] = np.frombuffer(b"".join(pieces), np.uint8)
        size, data = held["size"], held["bytes"]
        first = np.cumsum(size) - size
        for batch in batches:
            # null lists have no ids; ids that are null or outside the vocabulary have no bytes
            counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch.column(1).flatten(), -1).to_numpy(zero_copy_only=False)
            there = (ids >= 0) & (ids < len(size))
            at = np.where(there, ids, 0)
            width = np.where(there, size[at], 0)
            ends = np.concatenate([[0], np.cumsum(width)])
            whole = data[np.repeat(first[at] - ends[:-1], width) + np.arange(ends[-1])].tobytes()
            cuts = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=schema)

    return map_arrow(tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), run, "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the rows of ``decode``."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
