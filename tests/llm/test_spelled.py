"""No gate hides a spelled-out address from the generator."""

import random

import pytest

from tidewatch.llm import pii


@pytest.mark.parametrize("text", ["jane.roe AT example DOT com", "jane.roe at example.com", "write jane at\nexample\ndot\ncom", "jane\tAt\texample.org"])
def test_spelled_addresses_are_proposed(text):
    assert any(kind == "email" for kind, *_ in pii.proposals(text))


def test_proposals_are_all_matches_of_the_pattern():
    r = random.Random(9)
    parts = ["jane", "x.y", " ", "\n", " ", " ", "at", "AT", "dot", "Dot", ".", "@", "(", ")", "[", "]", "{", "}", "com", "é"]
    for _ in range(5000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert [p[1:] for p in pii.proposals(x) if p[0] == "email"] == [m.span() for m in pii.SPELLED.finditer(x)]
