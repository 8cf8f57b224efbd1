"""Line dedup of lines of every length, as the query and the pipeline run it."""

import hashlib
import random

import pytest

from tests.llm import brute
from tests.llm.test_operators import DOCS, SCHEMA
from tidewatch.llm import line_dedup, queries


def short():
    r = random.Random(21)
    few = [f"w{k}" for k in range(9)]
    lines = lambda: "\n".join(" ".join(r.choice(few) for _ in range(r.randint(0, 7))) for _ in range(r.randint(0, 6)))
    return DOCS + [(1000 + k, x) for k, x in enumerate([*(lines() for _ in range(60)), "Read more\n\n\nShare", "share\nread  MORE\n\n", "a b c\na b c d", "d c a\nb a\na b c"])]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, 4) for i, t in short()], SCHEMA).repartition(5)


@pytest.mark.parametrize("few", [16, 1])
def test_lines_of_every_length(rows, few):
    got = {r.doc_id: sorted(r.lines) for r in line_dedup.removed_lines(rows, least=1, few=few).collect()}
    assert got == brute.lines(short(), least=1)
    assert got[1061] == [0, 1]


@pytest.mark.parametrize("few", [16, 1])
def test_split_lists(spark, few):
    """One word in every line, as rare as the others: its list is split, and no link between its parts is lost."""
    r = random.Random(5)
    base = [" ".join(["common", *(r.choice("abcdefghijklmnop") * 2 for _ in range(r.randint(3, 9)))]) for _ in range(150)]
    docs = [(k, "\n".join(r.choice(base) + r.choice(["", " zz", f" y{k}"]) for _ in range(3))) for k in range(200)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    want = brute.lines(docs, least=1)
    for size in (5, 40):
        assert {r.doc_id: sorted(r.lines) for r in line_dedup.removed_lines(rows, least=1, few=few, size=size).collect()} == want


def test_query_and_pipeline_take_short_lines(spark, rows, tmp_path):
    import corpus_pipeline

    rows.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    gone = brute.lines(short(), least=1)
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in short()}
    digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (len(gone.get(i, ())), digest(t)) for i, t in want.items()}
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, rows, "").collect()} == want
