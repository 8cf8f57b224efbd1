"""The capitals voter of toxicity looks at the whole text."""

import random

from tidewatch.llm import toxicity


def test_capitals_are_counted_over_the_whole_text():
    votes = toxicity.Votes([])
    assert votes.of("quiet words " * 200 + "SHOUTING WITHOUT END " * 400)[-1]
    assert not votes.of("A LOUD OPENING " * 140 + "and then a long calm text " * 400)[-1]


def test_capitals_equal_the_plain_count():
    r = random.Random(5)
    for _ in range(2000):
        text = "".join(r.choice("aZ .1éÉßΣσǅⅣⓐªİ漢\n") for _ in range(r.randint(0, 60)))
        assert toxicity.capitals(text) == (sum(map(str.isupper, text)), sum(map(str.isalpha, text)))
