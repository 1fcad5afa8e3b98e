import difflib
import random
import time

import pytest

from mailspark.operators import similarity
from mailspark.operators.similarity import alike


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, False).ratio()


def edited(rng, text, share, letters):
    out = []
    for c in text:
        dice = rng.random()
        if dice < share / 3:
            continue
        out.append(rng.choice(letters) if dice < share else c)
        if dice > 1 - share / 3:
            out.append(rng.choice(letters))
    return "".join(out)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "aé\U0001f600\ud800"])
def test_verdicts_are_those_of_difflib(monkeypatch, letters):
    # No range is small, so that every block comes from the ranks.
    monkeypatch.setattr(similarity, "_SMALL", 0)
    rng = random.Random(len(letters))
    for _ in range(150):
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        b = edited(rng, a, rng.random(), letters)
        if rng.random() < 0.3:
            cut = rng.randrange(len(b) + 1)
            b = b[cut:] + b[:cut]
        exact = ratio(a, b)
        for threshold in (exact, exact + 1e-9, exact - 1e-9, 0.0, 0.5, 0.8, 1.0):
            assert alike(a, b, threshold) == (exact >= threshold)


def test_longest_block_is_the_first():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in "ab")
        lo, hi = sorted((rng.randrange(len(a) + 1), rng.randrange(len(a) + 1)))
        want = difflib.SequenceMatcher(None, a, b, False).find_longest_match(lo, hi, 0, len(b))
        got = similarity._Ranks(a, b).longest(lo, hi, 0, len(b))
        assert got[2] == want.size and (not want.size or got == tuple(want))


def test_empty():
    assert alike("", "", 1.0) and not alike("", "a", 0.1) and alike("", "a", 0.0)


def test_long_bodies_without_common_lines():
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    a, b = (" ".join(rng.choice(words) for _ in range(2300)) for _ in "ab")
    assert min(len(a), len(b)) > 12_000
    start = time.perf_counter()
    assert not alike(a, b, 0.8)
    # The same words in another order of halves: half of it matches, the bound is 1.
    assert not alike(a, a[6000:] + a[:6000], 0.8)
    assert alike(a, edited(rng, a, 0.1, "xyz"), 0.8)
    assert time.perf_counter() - start < 3


def test_hashes_find_the_first_longest_block():
    rng = random.Random(3)
    for letters in ("ab", "aé\U0001f600\ud800"):
        for _ in range(200):
            a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in "ab")
            lo, hi = sorted((rng.randrange(len(a) + 1), rng.randrange(len(a) + 1)))
            want = difflib.SequenceMatcher(None, a, b, False).find_longest_match(lo, hi, 0, len(b))
            got = similarity._Hashes(a, b).longest(lo, hi, 0, len(b))
            assert got[2] == want.size and (not want.size or got == tuple(want))


def test_hashes_that_meet_by_chance_leave_it_to_the_ranks(monkeypatch):
    monkeypatch.setattr(similarity, "_SMALL", 0)
    # Every hash is the same.
    monkeypatch.setattr(similarity._Hashes, "_of", lambda self, side, low, high, n: similarity.np.zeros(high + 1 - low - n, similarity.np.uint64))
    rng = random.Random(4)
    for _ in range(100):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in "ab")
        for threshold in (ratio(a, b), ratio(a, b) + 1e-9, 0.5):
            assert alike(a, b, threshold) == (ratio(a, b) >= threshold)


def test_long_bodies_need_no_ranks(monkeypatch):
    def fail(*_):
        raise AssertionError("ranks of all substrings")

    monkeypatch.setattr(similarity, "_Ranks", fail)
    rng = random.Random(6)
    a = "".join(rng.choice("etaoin shrdlu") for _ in range(20_000))
    assert not alike(a, a[9000:] + a[:9000], 0.8) and alike(a, a[3000:] + a[:3000], 0.8)


def test_the_bound_is_that_of_difflib():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in "ab")
        exact = difflib.SequenceMatcher(None, a, b, False).quick_ratio()
        for threshold in (exact, exact + 1e-9, exact - 1e-9, 1.0):
            assert similarity.bound_reaches(a, b, threshold) == (exact >= threshold)


def test_texts_of_one_row_group_are_dealt_to_all_tasks(spark, sf):
    from mailspark.checks.queries import QUERIES

    plan = QUERIES["quote_diff"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Exchange")
