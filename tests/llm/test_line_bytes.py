"""Bytes that line dedup sends, and how rows are told apart in it."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, packing


def test_a_posting_takes_few_bytes():
    r = np.random.default_rng(5)
    n = 2000
    rows = {name: r.integers(0, 1 << 62, n).astype(line_dedup.RECORD[name]) for name in ("token", "key", "x", "y")}
    rows["token"] &= np.uint64((1 << line_dedup.SHORT) - 1)
    rows["key"] &= np.uint64((1 << line_dedup.SHORT) - 1)
    for name, most in (("line", 40), ("n", 100), ("p", 20)):
        rows[name] = r.integers(0, most, n).astype(np.int32)
    rows["doc"], rows["hash"] = np.sort(r.integers(0, 1000, n)) - 500, np.zeros(n, np.int64)
    raw = line_dedup.pack(rows)
    assert len(raw) == n * line_dedup.WIDTH
    sent = line_dedup.squeeze(raw)
    assert len(sent) < 36 * n  # 26 of them are random here
    back = line_dedup.unpack([line_dedup.expand(sent), raw])
    for name in rows:
        assert back[name].dtype == line_dedup.RECORD[name] and (back[name] == np.tile(rows[name], 2)).all()
    assert len(line_dedup.unpack([])["token"]) == 0


def test_copies_and_collisions():
    rows = {name: np.zeros(4, line_dedup.RECORD[name]) for name in line_dedup.RECORD.names}
    rows["key"][:] = (1, 1, 1, 2)
    rows["n"][:] = 4
    rows["x"][:] = (0, 0, 6, 0)  # the third agrees in its short key alone
    rows["doc"][:] = (3, 2, 4, 5)
    got, a, b, _ = line_dedup.candidates(rows, 60, None)
    assert got["doc"].tolist() == [2, 4, 5]
    assert sorted(zip(got["doc"][a].tolist(), got["doc"][b].tolist(), strict=True)) == [(4, 2), (5, 2), (5, 4)]


def test_rows_are_told_apart_by_text_only_where_ids_repeat(spark):
    one, two = "a b c d e f g h\nx y z u v w", "a b c d e f g h\nk l m n o p"
    single = spark.createDataFrame([(1, one), (2, two), (None, one), (3, None)], "doc_id long, text string")
    own, unique = line_dedup.told_apart(single)
    assert unique and {r.thash for r in own.collect()} == {0} and own.count() == 2
    repeated = single.unionByName(spark.createDataFrame([(2, one), (2, one)], "doc_id long, text string"))
    own, unique = line_dedup.told_apart(repeated)
    assert not unique and {(r.doc_id, r.thash == r.whole) for r in own.collect() if r.doc_id == 2} == {(2, True)}
    got = {(r.doc_id, r.thash): sorted(r.lines) for r in line_dedup.removed_lines(single, least=1).collect()}
    want = single.where("doc_id = 2").select(F.xxhash64("text")).first()[0]
    assert got == {(2, want): [0]}


def test_an_idle_encoder_holds_few_words():
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.known.update((b"%d" % i, b"0000") for i in range(120_000))
    encoder.held["again"].update(encoder.known)
    encoder.rest()
    assert len(encoder.known) <= 50_000 and not encoder.held["again"]
