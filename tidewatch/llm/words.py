"""Words of whole texts as arrays: a word is a run of bytes other than space and \\x09-\\x0D."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from tidewatch.llm.common import mix64

LONG = 128  # bytes; longer words are hashed one by one
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Odd multiplier of the polynomial hash over word hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class Words:
    """All words of a batch of texts. ``first[d]:first[d + 1]`` are the words of text d."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if lower:
            data = data | ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
        self.data, self.offsets = data, offsets
        inside = (data != 32) & (data - np.uint8(9) > 4)
        # words begin and end by turns
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        turns = np.concatenate([np.zeros(int(inside[:1].sum()), np.int64), turns, np.full(int(inside[-1:].sum()), len(data))])
        self.starts, self.ends = turns[0::2], turns[1::2]
        at = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
        at = at[inside[at] & inside[at - 1]]  # a text's last word ends with it
        if len(at):
            self.starts = np.insert(self.starts, np.searchsorted(self.starts, at), at)
            self.ends = np.insert(self.ends, np.searchsorted(self.ends, at), at)
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        size = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        windows = np.ndarray((len(self.data) + 1,), np.dtype("<u8"), padded, 0, (1,))
        out = mix64(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        if len(size):
            out = mix64(out ^ (windows[self.starts] & _MASKS[np.minimum(size, 8)]))
            which, step = np.flatnonzero((size > 8) & (size <= LONG)), 8
            while len(which):
                left = size[which] - step
                out[which] = mix64(out[which] ^ (windows[self.starts[which] + step] & _MASKS[np.minimum(left, 8)]))
                step += 8
                which = which[left > 8]
            raw = self.data.tobytes() if (size > LONG).any() else b""
            for i in np.flatnonzero(size > LONG):
                out[i] = xxhash.xxh64_intdigest(raw[self.starts[i] : self.ends[i]])
        return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; positions too near the end are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(BASE) + hashes[j : n + j]
    return mix64(out)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, by doubling."""
    out = np.ones(n + 1, np.uint64)
    done, step = 1, base
    while done <= n:
        more = min(done, n + 1 - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step % (1 << 64)
    return out


def ranges_hash(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words begin:end for each range, from prefix sums of a polynomial modulo 2**64."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes), BASE)[:-1], out=sums[1:])
    return mix64((sums[end] - sums[begin]) * powers(len(hashes), INVERSE)[begin] + (end - begin).astype(np.uint64))
