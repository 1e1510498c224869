import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.functions import runs
from corpuscle.llm import splitting as S

CHUNK = "id string, text string"
CLAIM = "id string, verbatim string, char_start int, char_end int"


def longest_run(text):
    best = run = 0
    for c in text:
        stop = runs.categories()[ord(c)] in (runs.SPACE, runs.PUNCTUATION)
        run = 0 if stop else run + 1
        best = max(best, run)
    return best


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c.\n,é中。 \t\"", max_size=160), st.integers(6, 30), st.integers(0, 5))
def test_pieces_cover_the_text_under_the_limit(text, limit, overlap):
    pieces = S.cut(text, limit, overlap)
    inner = text.strip(" \t\r\n")
    if not inner:
        assert pieces == []
        return
    assert pieces[0][0] == len(text) - len(text.lstrip(" \t\r\n")) and pieces[-1][1] == len(text.rstrip(" \t\r\n"))
    for (a, b, _, _), (c, d, shared, _) in zip(pieces, pieces[1:]):
        assert c <= b < d and shared == b - c and shared in (0, overlap, b - a - 1)
    assert all(0 < b - a <= limit for a, b, _, _ in pieces)
    # Forced exactly where some run without blanks and punctuation is too long.
    assert max(p[3] for p in pieces) == int(longest_run(text) > limit)


@pytest.mark.parametrize("seed", range(3))
def test_range_maximum(seed):
    import numpy as np

    values = np.random.default_rng(seed).integers(0, 4, 50)
    table = S.RangeMaximum(values)
    for low in range(50):
        for high in range(low, 50):
            part = values[low : high + 1]
            place = low + len(part) - 1 - int(part[::-1].argmax())
            assert table.best(low, high) == (int(part.max()), place)


def test_found_items(spark):
    r = random.Random(1)
    words = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(400))
    chunks = [("c1", words), ("c1", words), ("c2", "x" * 1001), ("c3", "y" * 1000 + "   "), ("c4", None), ("c5", ""), ("c6", "z" * 1000 + ". " + words), (None, words)]
    claims = [("k1", "v" * 601, None, None), ("k2", "short", 0, 700), ("k3", None, 5, 900), ("k4", words, 0, 10), ("k5", words, 10, 5), ("k6", None, None, None)]
    got = {tuple(x) for x in S.forced_items(S.split_oversized(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(claims, CLAIM))).collect()}
    assert got == {("chunk", "c1", 0), ("chunk", "c2", 1), ("chunk", "c6", 0), ("claim", "k1", 1), ("claim", "k2", 0), ("claim", "k3", 0), ("claim", "k5", 0)}


def test_empty(spark):
    assert S.split_oversized(spark.createDataFrame([], CHUNK), spark.createDataFrame([], CLAIM)).count() == 0


def test_the_table_has_no_more_levels_than_a_window_needs():
    table = S.RangeMaximum(S.strengths("some words, here. " * 4000), 600)
    assert len(table.levels) == 10
    assert table.best(100, 699) == S.RangeMaximum(S.strengths("some words, here. " * 4000)).best(100, 699)
