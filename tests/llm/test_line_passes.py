"""The passes of line dedup: one over all texts for copies, counts and a share of the texts, and the order of postings."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, setjoin


def test_one_pass_finds_copies_and_a_share_of_the_texts(spark):
    rows = [(k, f"Same words here\nonly {k}\n\nwords same HERE") for k in range(300)] + [(7, "x y z"), (None, "x y z"), (400, None)]
    own, _ = line_dedup.told_apart(spark.createDataFrame(rows, "doc_id long, text string"))
    copies, texts, some, counts, postings = line_dedup.first_pass(own, 1, 75, 4)
    got = sorted((r.doc_id, r.line) for r in copies.collect())
    assert got == sorted([(0, 3)] + [(k, line) for k in range(1, 300) for line in (0, 3)])
    assert texts.count() == 301 and {r.doc_id for r in texts.collect()} == set(range(300))
    assert sorted(r.text for r in some.collect()) == sorted(r.text for r in own.where(F.pmod(F.xxhash64("thash", "doc_id"), F.lit(4)) == 0).collect())
    assert 0 < some.count() < 301 and counts.sum() == 300 * 8 + 3
    assert postings == 601 * 1  # sets of three words: one word; of two: none


def test_postings_are_in_order_of_word_id_and_line():
    r = np.random.default_rng(3)
    for repeat in (False, True):
        n = 3000
        rows = {c: np.zeros(n, line_dedup.RECORD[c]) for c in line_dedup.RECORD.names}
        rows["token"][:] = r.integers(0, 1 << 9, n) << 31
        rows["doc"][:] = r.integers(-40, 40, n)
        rows["line"][:] = r.integers(0, 9, n)
        rows["hash"][:] = r.integers(0, 3, n) if repeat else 0
        order = line_dedup.in_order(rows)
        got = list(zip(*(rows[c][order].tolist() for c in ("token", "doc", "line", "hash")), strict=True))
        assert sorted(order.tolist()) == list(range(n)) and got == sorted(got)


def test_sets_with_words_that_agree_in_most_bits():
    token = np.array([5, 4, 5, 1 << 63, 4, 5], np.uint64)  # the first bits don't tell 4 from 5
    sets = setjoin.OrderedSets(np.array([0, 0, 0, 0, 2, 2]), token, 3, None)
    assert sets.size.tolist() == [3, 0, 2] and sets.sorted.tolist() == [4, 5, 1 << 63, 4, 5]
    other = setjoin.OrderedSets(np.array([0, 0, 0, 2]), token[:4], 3, None)
    assert setjoin.similar(sets, other, 60).tolist() == [True, False, False] and not setjoin.similar(sets, other, 70).any()
    assert setjoin.similar(sets, sets, 100).tolist() == [True, False, True]


def test_lines_are_cut_by_their_bytes():
    texts = ["a\n\né b", "", "\n", "c"]
    raw, doc, line, begin, end = line_dedup.line_places(pa.array(["zz", *texts, "zz"]).slice(1, 4))
    got = [(d, k, raw[x:y].decode()) for d, k, x, y in zip(doc.tolist(), line.tolist(), begin.tolist(), end.tolist(), strict=True)]
    assert got == [(d, k, x) for d, text in enumerate(texts) for k, x in enumerate(text.split("\n"))]
