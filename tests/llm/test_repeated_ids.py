"""Rows that share an id, numbers beyond 64 bits, and input columns named like helpers."""

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, ngram_join, topk


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string")


A = "one two three four five six seven eight nine ten eleven twelve"
B = "aa bb cc dd ee ff gg hh ii jj kk ll"
C = "mm nn oo pp qq rr ss tt uu vv ww xx"


def test_lines_of_a_repeated_id(spark):
    """Only the text with the similar line loses it, not the other text of that id."""
    docs = rows(spark, [(1, A), (5, f"totally different words that stand here alone\n{B}"), (5, f"{A} iii\nkeep this other line"), (5, "x\ny")])
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs, least=1).collect())
    assert got == sorted([(1, A), (5, f"totally different words that stand here alone\n{B}"), (5, "keep this other line"), (5, "x\ny")])


def test_all_texts_of_a_repeated_id_are_linked(spark):
    docs = rows(spark, [(1, A), (2, B), (3, C), (5, A), (5, B), (5, C), (9, "alone in the whole wide world of words")])
    got = {(r.doc_id, r.component_id) for r in ngram_join.join_components(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 1), (9, 9)}
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == [1, 9]


def test_columns_named_like_helpers(spark):
    helpers = ["__may", "__MAY_", "__id", "__thash", "__lines", "__first", "m", "node", "line", "lines", "thash", "one", "two", "gid", "component"]
    docs = rows(spark, [(1, A), (2, f"{A} iii\n{B}"), (3, None), (3, ""), (None, A), (4, A), (4, C)])
    wide = docs.withColumns({c: F.lit(f"own {c}") for c in helpers})
    for out in (line_dedup.dedup_lines(wide, least=1), ngram_join.keep_one(wide)):
        assert out.columns == wide.columns
        assert all(r[c] == f"own {c}" for r in out.collect() for c in helpers)
    none = wide.limit(0)
    assert line_dedup.dedup_lines(none, least=1).count() == 0 and ngram_join.keep_one(none).count() == 0


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, weights int, block int, rank int")


def test_large_components(spark):
    data = [(k, v, 1, 2, 3) for k, v in [(0, [5e6] * 4), (1, [-5e6] * 4), (2, [5e6, 5e6, 5e6, 0.0]), (3, [0.5] * 4), (4, []), (50, [2.0**20] * 2), (None, [1.0]), (51, None)]]
    q = topk.quantized(vectors(spark, data))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(q, q.where(F.col("vec_id") % 50 == 0)).orderBy("query_id", "rank").collect()]
    w = {r[0]: [int(x * 256) for x in r[1]] for r in data if r[0] is not None and r[1] is not None}
    want = []
    for i in (0, 50):
        found = sorted(((-sum(a * b for a, b in zip(w[i], w[j], strict=False)), j) for j in w if j != i))[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(found)]
    assert got == want


@pytest.mark.parametrize("big", [1e300, 2.0**40])
def test_beyond_64_bits_is_an_error(spark, big):
    q = topk.quantized(vectors(spark, [(0, [big, 1.0], 1, 2, 3), (1, [big, 1.0], 1, 2, 3)]))
    with pytest.raises(Exception, match="64-bit"):
        topk.top_k(q, q).collect()


def test_repeated_query_ids_give_one_list(spark):
    data = [(0, [3.0], 1, 1, 1), (0, [-2.0], 1, 1, 1), (1, [1.0], 1, 1, 1), (2, [-1.0], 1, 1, 1)]
    for order in (data, data[::-1]):
        q = topk.quantized(vectors(spark, order))
        got = [(r.rank, r.vec_id) for r in topk.top_k(q, q.where("vec_id = 0"), k=2).orderBy("rank").collect()]
        assert got == [(1, 2), (2, 1)]
