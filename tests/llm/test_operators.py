"""The operators against brute force on a small fixture with nulls, blanks, copies, ties and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tidewatch.llm import bpe, line_dedup, ngram_join, packing, pii, setjoin, simhash, substring, topk, toxicity, warc

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, seg string, node int, `__x` int, n int, tokens int"


def fixture():
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = sentence(70)
    texts = [None, "", " \t\n", "one", "One", "two words", "a b \x1c c"]
    texts += ["\n".join(sentence(r.randint(1, 30)) for _ in range(r.randint(1, 8))) for _ in range(40)]
    base = sentence(120)
    for k in range(30):  # near copies, exact copies, shared passages
        w = base.split()
        for _ in range(k % 7):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts += [" ".join(w), f"{sentence(20)}\n{passage}\n{sentence(k)}"]
    texts += [base] * 4 + [base.upper(), "x " * 3000, "y" * 5000, "mail a.b@c.de, +1 (234) 567-8901 4111111111111111 at 10.0.0.1"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


DOCS = fixture()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, 4) for i, t in DOCS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("group,chunk", [(4096, 4096), (3, 8)])
def test_substring(docs, none, group, chunk):
    want = brute.repeats([d for d in DOCS], 50)
    kept = substring.remove_repeats(docs, substring.repeated_spans(docs, group=group, chunk=chunk))
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in kept.collect()}
    assert got == want and any(x[1] for x in want.values())
    assert substring.remove_repeats(none, substring.repeated_spans(none)).count() == 0


def test_ngram_components(docs, none):
    want = brute.components(DOCS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(docs).collect()} == want
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert ngram_join.join_components(none).count() == 0


def test_ngram_lists_of_frequent_tokens(docs, monkeypatch):
    """Tokens that a task holds often are dealt by group, in many blocks and flushes: the same components."""
    for name, value in (("MANY", 3), ("FLUSH", 200), ("BLOCK", 50)):
        monkeypatch.setattr(setjoin, name, value)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(docs).collect()} == brute.components(DOCS)


@pytest.mark.parametrize("few", [16, 1])
def test_lines(docs, none, few):
    got = {r.doc_id: sorted(r.lines) for r in line_dedup.removed_lines(docs, few=few).collect()}
    assert got == brute.lines(DOCS) and got
    assert line_dedup.removed_lines(none).count() == 0


def test_drop_lines_keeps_the_rest(docs):
    gone = brute.lines(DOCS)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in DOCS}
    assert {r.doc_id: r.text for r in out.collect()} == want


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, text), (2, text), (2, text), (1, text)], "doc_id long, text string")
    kept = substring.remove_repeats(df, substring.repeated_spans(df)).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in kept) == [(-1, 0), (1, 0), (2, 60), (2, 60)]
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.join_components(df).collect()) == [(-1, -1), (1, 1), (2, 1), (2, 1)]
    assert sorted((r.doc_id, r.lines) for r in line_dedup.removed_lines(df).collect()) == [(2, [0])]


def test_packing(docs, none):
    tokenizer = Tokenizer.from_file(WORD)
    rows = packing.pack_documents(docs, WORD).collect()
    total = 0
    for i, text in DOCS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        cut = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [(2048 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    filled = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-total // 2048) + 1
    assert packing.pack_documents(none, WORD).count() == 0


def test_best_fit_takes_the_tightest_bin():
    r = random.Random(3)
    lengths = np.array([r.randint(1, 100) for _ in range(400)])
    bins, _, left = packing.best_fit_decreasing(lengths, 100)
    want, room = {}, []
    for i in np.argsort(-lengths, kind="stable"):
        fits = sorted((room[b], b) for b in range(len(room)) if room[b] >= lengths[i])
        if not fits:
            room.append(100)
            fits = [(100, len(room) - 1)]
        want[i] = fits[0][0]
        room[fits[0][1]] -= lengths[i]
    assert len(left) == len(room) and sorted(left) == sorted(room) and len(bins) == len(want)


def test_word_encoder_is_exact():
    r, tokenizer, encoder = random.Random(5), Tokenizer.from_file(WORD), packing.WordEncoder(WORD)
    alphabet = ["a", "Th", "THE,", "end.", "İ", "x,", "É.", "é", "ㄱ", "Σ", "<|endoftext|>", "<|ENDOFTEXT|>", "...", "3.14", "Don't", " ", "\n", "\x85", "　"]
    for _ in range(500):
        x = "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))
        w = encoder.words(x)
        encoder.learn(set(w))
        assert np.frombuffer(b"".join(encoder.known[y] for y in w), "<u4").tolist() == tokenizer.encode(x, add_special_tokens=False).ids


def test_bpe(docs, none):
    tokenizer = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()}
    for i, text in DOCS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].text == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode(none, BYTE).count() == 0


def test_pii(docs, none):
    model = pii.train(docs)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base] for r in pii.find_spans(docs, model).collect()}
    assert got == {i: brute.spans(t or "") for i, t in DOCS}
    r = random.Random(2)
    alphabet = ["a", "7", "@", ".", "-", "+", " ", "(", ")", "é", "x1", "192.168.0.1", "4111111111111111", "a@b.co", "+1 (234) 567-8901", "_"]
    for _ in range(3000):
        x = "".join(r.choice(alphabet) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(x) == brute.spans(x)
    out = pii.redact(docs, model)
    assert out.columns == docs.columns and out.where("text like '%a.b@c.de%' or text like '%10.0.0.1%'").count() == 0
    assert pii.find_spans(none).count() == 0


def test_simhash(docs, none):
    rows = {r.doc_id: r for r in simhash.compare_edited(docs).collect()}
    order = sorted(((i, t or "") for i, t in DOCS), reverse=True)
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i].near_next <= 1 and 0 <= rows[i].near_edited <= 1
    assert simhash.compare_edited(none).count() == 0
    prints = simhash.fingerprint(docs)
    every = sorted({r.fingerprint for r in prints.collect()})
    want = {(a, b) for a in every for b in every if (int(a, 16) ^ int(b, 16)).bit_count() <= 6}
    assert {(r["query"], r.fingerprint) for r in simhash.within_radius(prints, prints, 6).collect()} == want


def test_top_k(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([0.0, 0.25, -0.5, r.random()]) for _ in range(6)]) for i in range(120)] + [(500, None), (550, [float("nan")] * 6), (600, [None, 1.0]), (650, []), (700, [0.5, 0.5])]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, 16, 2).collect()))
    plain = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in plain if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(plain[q], v, strict=False)), i) for i, v in plain.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert got == sorted(want)


def test_warc(spark):
    long = "z" * 200
    pages = spark.createDataFrame([(1, "http://a/\r\nx é", "<p>é</p>"), (5, None, long), (3, "u", long), (4, "u", long), (7, "v", None), (8, "v", "<p>é</p>")], "page_id long, url string, html string")
    index = warc.write_archives(warc.plan(pages))
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 8: ("response", None), 7: ("response", None), 3: ("response", None), 4: ("revisit", 3), 5: ("revisit", 3)}
    assert bytes(got[1].payload) == "<p>é</p>".encode() and got[4].payload is None and got[4].payload_bytes == 200
    assert got[5].payload_digest == hashlib.sha256(long.encode()).hexdigest() and got[7].payload_bytes == 0
    some = warc.read_records(index.where(F.col("page_id").isin(1, 7)))
    assert sorted(r.page_id for r in some.collect()) == [1, 7]
    assert warc.write_archives(warc.plan(pages.limit(0))).count() == 0


def test_toxicity_on_held_out_labels(spark):
    """Labels here are clean, so held-out documents must be told apart almost without error."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scorer = toxicity.train(docs, labels)
    rows = toxicity.score(docs, scorer).join(labels, "doc_id").where(toxicity.held_out()).collect()
    right = np.mean([(r.score >= 0.5) == bool(r.toxic) for r in rows])
    alarms = np.mean([r.score >= 0.5 for r in rows if not r.toxic])
    assert right > 0.97 and alarms < 0.01
    assert toxicity.train(docs, labels.limit(0)).weights is None
    assert 0 < toxicity.keep_clean(docs, scorer).count() < docs.count()


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    packed = corpus_pipeline.pack(spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
