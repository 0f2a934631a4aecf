import random
import time
from difflib import SequenceMatcher

import pytest

from corpusweft.functions import matching


def texts(rng, alphabet, most):
    x = "".join(rng.choices(alphabet, k=rng.randint(0, most)))
    y = list(x) if rng.random() < 0.6 else rng.choices(alphabet, k=rng.randint(0, most))
    for _ in range(rng.randint(0, 9)):
        at = rng.randrange(len(y) + 1)
        y[at : at + rng.randint(0, 12)] = rng.choices(alphabet, k=rng.randint(0, 12))
    return x, "".join(y)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij \U0001f600系", "abcdefghijklmnopqrstuvwxyz ,.ABCDEFGHIJ0123456789"])
def test_ratios_are_those_of_difflib(alphabet):
    rng = random.Random(1)
    pairs = [texts(rng, alphabet, 330) for _ in range(400)] + [("", ""), ("a", ""), ("", "b"), ("x" * 500, "x" * 300), ("ab" * 99, "ba" * 99), ("a" * 199, "a" * 200)]
    assert matching.ratios(*zip(*pairs)) == [SequenceMatcher(None, x, y).ratio() for x, y in pairs]


def test_bounds_are_never_below_the_matching_characters():
    from collections import Counter

    rng = random.Random(2)
    for _ in range(300):
        x, y = texts(rng, "abcdefghij ", 150)
        second = matching.Second(y)
        assert second.matching(x) <= second.at_most(x) <= second.common(Counter(x))
        assert second.common(Counter(x)) == sum((Counter(x) & Counter(y)).values())


def test_lines_of_prose_take_less_than_half_of_what_difflib_takes():
    rng = random.Random(3)
    words = ["the", "anon", "with", "thereing", "stion", "of", "erenand", "in", "hat", "ble"]
    lines = [" ".join(rng.choices(words, k=rng.randint(14, 90))) for _ in range(120)]
    pairs = list(zip(lines, lines[1:]))
    start = time.process_time()
    wanted = [SequenceMatcher(None, x, y).ratio() for x, y in pairs]
    between = time.process_time()
    assert matching.ratios(*zip(*pairs)) == wanted
    assert 2 * (time.process_time() - between) < between - start
