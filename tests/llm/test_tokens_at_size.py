"""Encoding work and memory that grow with what is new, not with what is remembered; the ids are the library's."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewatch.llm import bpe, common, packing

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def texts():
    r = random.Random(5)
    letters = "ab sé\n\t ,'!<|>. 1²ß\x1c\xa0İΣẞ "
    out = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    return [*out, "a<|endoftext|> b", "word!!! word, (word) ab's ab' <|startoftext|>", "aaaa aaaaaaaaaaa," * 40]


def test_signs_behind_letters_are_not_encoded_with_them():
    encoder = packing.WordEncoder(WORD)
    packing.forget(encoder.held, 0)
    asked = []

    class Spy:
        def encode_batch_fast(self, parts, add_special_tokens):
            asked.extend(parts)
            return real.encode_batch_fast(parts, add_special_tokens=add_special_tokens)

    real, encoder.tokenizer = encoder.tokenizer, Spy()
    encoder.learn({b"alpha%%%", b"alpha!!", b"alpha", "grün--".encode()})
    assert sum("alpha" in x for x in asked) == 1 and len(encoder.known) == 8
    packing.forget(encoder.held, 0)
    tokenizer = Tokenizer.from_file(WORD)
    for text in texts():
        words = encoder.words(text)
        encoder.learn(set(words))
        got = np.frombuffer(b"".join(encoder.known[w] for w in words), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_that_come_once_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    monkeypatch.setattr(packing, "IDLE_WORDS", 5)
    encoder = packing.WordEncoder(WORD)
    packing.forget(encoder.held, 0)
    for k in range(40):
        encoder.learn({b"often", *(f"{x}{k // 2}".encode() for x in "abcdef")})
        assert b"often" in encoder.known and len(encoder.known) <= 20 + 7
    encoder.rest()
    assert len(encoder.known) <= 5
    held = {"known": {1: b"x", 2: b"y"}, "again": set()}
    assert common.unknown({2, 3}, held, 9) == {3} and held["again"] == {2}
    common.forget(held, 1)
    assert held == {"known": {2: b"y"}, "again": set()}


def test_merges_rank_only_pairs_that_changed(monkeypatch):
    pairs, tokenizer = bpe.BytePairs(BYTE), Tokenizer.from_file(BYTE)
    ranked = []
    real = pairs.ranks
    monkeypatch.setattr(pairs, "ranks", lambda a, b: ranked.append(len(a)) or real(a, b), raising=False)
    some = texts()
    words = [p for t in some for p in pairs.pieces(t)]
    plain = [w for w in words if not isinstance(w, int)]
    ids = iter(pairs.encode_words([w.encode() for w in plain]))
    made = iter([[w] if isinstance(w, int) else np.frombuffer(next(ids), "<u4").tolist() for w in words])
    for t in some:
        assert [i for _ in pairs.pieces(t) for i in next(made)] == tokenizer.encode(t, add_special_tokens=False).ids
    symbols = sum(len(w.encode()) for w in plain)
    assert sum(ranked[:1]) < symbols and sum(ranked) < 3 * symbols
    assert pairs.encode_words([]) == [] and pairs.encode_words([b"", b"a"])[0] == b""


def test_decoded_ids(spark):
    pairs = bpe.BytePairs(BYTE)
    rows = [(1, [0, 50256, 299, -1, 10**6, None]), (2, None), (3, []), (None, list(range(100, 400)))]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1), BYTE).collect()
    assert [(r.doc_id, r.ids) for r in got] == rows
    for r in got:
        raw = b"".join(pairs.bytes[i] for i in r.ids or () if i is not None and 0 <= i < pairs.width)
        assert r.text == raw.decode("utf-8", "replace")
