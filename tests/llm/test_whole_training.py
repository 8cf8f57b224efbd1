"""The model of personal data learns from every row."""

import numpy as np

from tidewatch.llm import pii
from tidewatch.llm.boosting import BoostedTrees


def test_blocks_give_the_trees_of_one_table(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (600, 4)).astype(float)
    y = (x[:, 0] + (x[:, 2] > 5) * 3 + rng.normal(0, 1, 600) > 6).astype(float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)))[:-1] for j in range(4)]
    bins = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]).astype(np.uint8)
    parts = [(bins[k::3], y[k::3], np.ones(200)) for k in range(3)]
    one, many = BoostedTrees(rounds=6).fit(x, y), BoostedTrees(rounds=6).fit_blocks(spark.sparkContext.parallelize(parts, 3), cuts)
    assert np.abs(one.score(x) - many.score(x)).max() < 1e-3
    twice = [(b, v, 2 * n) for b, v, n in parts]
    more = BoostedTrees(rounds=6).fit_blocks(spark.sparkContext.parallelize(twice, 2), cuts)
    assert np.abs(BoostedTrees(rounds=6).fit(np.vstack([x, x]), np.hstack([y, y])).score(x) - more.score(x)).max() < 1e-3


def test_every_document_is_learned_from(spark, monkeypatch):
    assert not hasattr(pii, "SAMPLE") and not hasattr(pii, "CANDIDATES")
    texts = [(i, f"call +1 (212) 555-{1000 + i} or mail a{i}@example.org now, order 20{i % 90 + 10}-{i % 12 + 10}-{i % 20 + 10}") for i in range(60)]
    docs = spark.createDataFrame([*texts, (None, None)], "doc_id LONG, text STRING")
    seen = {}
    real = pii.BoostedTrees.fit_blocks

    def spy(self, blocks, cuts):
        seen["n"] = blocks.map(lambda b: float(b[2].sum())).sum()
        return real(self, blocks, cuts)

    monkeypatch.setattr(pii.BoostedTrees, "fit_blocks", spy)
    model = pii.train(docs)
    assert seen["n"] == sum(len(pii.training_rows(t)) for i, t in texts if i % 10 < 7)
    assert model.trees.trees and "email" in model.thresholds


def test_tasks_of_the_fit_follow_the_vectors(spark, monkeypatch):
    """Not the files and shuffle partitions that the vectors come from: the fit runs 120 jobs over them."""
    texts = [(i, f"call +1 (212) 555-{1000 + i} or mail a{i}@example.org now") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id LONG, text STRING").repartition(40)
    seen = []
    real = pii.BoostedTrees.fit_blocks

    def spy(self, blocks, cuts):
        seen.append(blocks.getNumPartitions())
        return real(self, blocks, cuts)

    monkeypatch.setattr(pii.BoostedTrees, "fit_blocks", spy)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        one = pii.train(docs)
        monkeypatch.setattr(pii, "BLOCK", 8)
        many = pii.train(docs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert seen[0] == 1 < seen[1]
    assert one.thresholds == many.thresholds
    assert all((x == y).all() for a, b in zip(one.trees.trees, many.trees.trees, strict=True) for x, y in zip(a, b, strict=True))
