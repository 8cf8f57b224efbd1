"""Proposals beside base spans: the same choice as comparing all spans with each other."""

import random
import time

import numpy as np

from tidewatch.llm import pii


class Scores:
    """Scores that follow from the features alone, with ties."""

    def score(self, x):
        return np.floor(np.abs(np.sin(x.sum(axis=1))) * 5) - 1


def plainly(model, text, base):
    found = [p for p in pii.proposals(text) if p[0] in model.thresholds and not any(a < p[2] and p[1] < b for _, a, b in base)]
    out = []
    if found:
        score = model.trees.score(np.array([pii.features(text, *p) for p in found]))
        for i in np.argsort(-score, kind="stable"):
            kind, a, b = found[i]
            if score[i] >= model.thresholds[kind] and not any(c < b and a < d for _, c, d in out):
                out.append((kind, a, b))
    return out


def test_same_choice():
    r = random.Random(8)
    model = pii.SpanModel(Scores(), {"email": 0.0, "card": 1.0, "phone": 0.0})
    words = ["jane", "(at)", " at ", "@", " dot ", ".", "example", "com", "4111 1111 1111 1111", "+1 (234) 567-8901", "555-123-4567", "10.0.0.1", " ", "\n", "x"]
    taken = 0
    for _ in range(3000):
        text = "".join(r.choice(words) for _ in range(r.randint(0, 25)))
        base = pii.base_spans(text)
        got = [s[:3] for s in model.added(text, base)]
        assert got == plainly(model, text, base)
        taken += len(got)
    assert taken > 500


def test_many_spans_in_one_text():
    model = pii.SpanModel(Scores(), {"email": -9.0, "phone": -9.0})
    text = " and ".join(f"user{k}@mail{k}.com or 555-{k:07d}" for k in range(20_000))
    base = pii.base_spans(text)
    began = time.monotonic()
    assert len(model.added(text, base)) >= 20_000 and len(base) >= 20_000
    assert time.monotonic() - began < 60
