"""Cases that the operators once answered for a part of the rows or of the text only."""

import random
from collections import Counter

import pyarrow as pa

from tests.llm.test_operators import DOCS, docs  # noqa: F401
from tidewatch.llm import simhash


def apart(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_radius_finds_texts_with_a_few_edited_words():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 10))) for _ in range(5000)]
    plain, edited = [], []
    for length, edits in [(200, 1), (200, 2), (200, 3), (400, 4)] * 100:
        w = [r.choice(vocabulary) for _ in range(length)]
        plain.append(" ".join(w))
        for k in r.sample(range(length), edits):
            w[k] = r.choice(vocabulary)
        edited.append(" ".join(w))
    a, b = (simhash.fingerprints(pa.array(x, pa.large_string())) for x in (plain, edited))
    assert sum(apart(x, y) <= simhash.RADIUS for x, y in zip(a, b, strict=True)) >= 0.9 * len(a)
    assert not any(apart(x, y) <= simhash.RADIUS for x, y in zip(a, b[1:], strict=False))


def test_others_within_the_production_radius_count_copies(docs):  # noqa: F811
    prints = simhash.fingerprint(docs).localCheckpoint()
    held = Counter(r.fingerprint for r in prints.collect())
    pairs = {(a, b, apart(a, b)) for a in held for b in held if apart(a, b) <= simhash.RADIUS}
    found = [(r["query"], r.fingerprint, r.distance) for r in simhash.within_radius(prints, prints).collect()]
    assert len(found) == len(pairs) and set(found) == pairs
    got = {r.fingerprint: r.others for r in simhash.others_within(prints.where("doc_id % 3 = 0"), prints).collect()}
    asked = {r.fingerprint for r in prints.where("doc_id % 3 = 0").collect()}
    assert got == {a: sum(held[b] for x, b, _ in pairs if x == a) - 1 for a in asked}
    assert max(got.values()) >= 4


def test_radius_at_every_size(spark):
    r = random.Random(12)
    base = r.getrandbits(128)
    values = [base]
    for bits in range(1, 21):
        values += [base ^ sum(1 << k for k in r.sample(range(128), bits)) for _ in range(10)]
        values.append(base ^ ((1 << bits) - 1))
    every = [f"{v:032x}" for v in values]
    prints = spark.createDataFrame([(x,) for x in every], "fingerprint string")
    for radius in (1, 5, 8, 11, 12, 14):
        got = simhash.within_radius(spark.createDataFrame([(every[0],)], "fingerprint string"), prints, radius).collect()
        assert Counter(x.fingerprint for x in got) == Counter({x for x in every if apart(every[0], x) <= radius})
