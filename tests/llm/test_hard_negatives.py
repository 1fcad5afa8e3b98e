import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailspark.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int"
NULL_LAST = 1 << 63


def brute(rows, positives=5, negatives=10):
    able, seen = [], set()
    for vec_id, e, label, *_ in rows:
        if label is None or e is None or any(x is None or not math.isfinite(np.float32(x)) for x in e):
            continue
        row = (vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in e))
        if row not in seen:
            seen.add(row)
            able.append(row)
    out = []

    def place(score, row):
        return (-score, NULL_LAST if row[0] is None else row[0])

    for a in able:
        if a[0] is None or a[0] % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b) for b in able if b is not a and len(a[2]) == len(b[2])]
        scored.sort(key=lambda s: place(*s))
        for p_score, p in [s for s in scored if s[1][1] == a[1]][:positives]:
            fit = [s for s in scored if s[1][1] != a[1] and 30 * p_score <= 100 * s[0] <= 90 * p_score]
            out += [(a[0], p[0], n + 1, q[0], p_score, score) for n, (score, q) in enumerate(fit[:negatives])]
    return out


def mined(spark, rows, extra=""):
    frame = spark.createDataFrame(rows, SCHEMA + extra)
    return [tuple(r) for r in H.hard_negatives(frame, F.col("vec_id") % 100 == 0).collect()]


def same(spark, rows, extra=""):
    got, expected = mined(spark, rows, extra), brute(rows)
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    return got


def vectors(seed, n, width, labels=4, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    raw = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, width))
    raw *= rng.exponential(1, (n, 1))
    return [(i, [float(x) for x in raw[i]], int(rng.integers(0, labels))) for i in range(n)]


def test_equals_brute_force_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET", 64)
    monkeypatch.setattr(H, "ANCHORS", 2)
    monkeypatch.setattr(H, "GROUP", 3)
    assert same(spark, vectors(1, 700, 8, spread=0.3))


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0 * (i % 7), 2.0, -1.0 * (i % 3)], i % 3) for i in range(120)]
    rows += [(100, [1.0, 0.0], 0), (300, [0.0, 0.0, 0.0], 1), (500, None, 1), (501, [nan, 1.0, 1.0], 1), (502, [1.0, None, 1.0], 1),
             (503, [inf, 0.0, 0.0], 2), (504, [1.0, 1.0, 1.0], None), (None, [1.0, 9.0, 0.0], 0), (None, [1.0, 3.5, 0.0], 1),
             (600, [], 0), (601, [], 1), (602, [], 0), (-100, [3.0, 2.0, 0.0], 2), (0, [0.0, 2.0, 0.0], 0), (0, [0.0, 2.0, 0.0], 0)]
    got = same(spark, rows)
    assert any(r[0] == 600 for r in got) and any(r[1] is None and r[3] is None for r in got)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2 ** 20 + i), 1.5, -float(2 ** 24 - i)], i % 2) for i in range(30)]
    rows += [(100 * i, [float(2 ** 22), -0.5, 3.0 * i], i % 2) for i in range(1, 4)]
    same(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    assert mined(spark, []) == []
    names = ", node string, vec string, q string, norm string, more string, i string, bucket string, part string, score string, rank string"
    rows = [(*r, *["x"] * 10) for r in vectors(2, 150, 4)]
    same(spark, rows, names)


@pytest.mark.parametrize("threshold", [50_000, 120_000, 300_000])
def test_pruning_loses_no_row(spark, threshold):
    rows = vectors(3, 500, 6, spread=0.2)
    frame = spark.createDataFrame(rows, SCHEMA)
    block = H._Block(H.length_buckets(H.whole_vectors(frame)).orderBy("bucket").first().asDict())
    pruned = 0
    for a in range(0, len(block.nodes), 7):
        focus = np.argsort(-np.abs(block.unit[a]))[:H.FOCUS]
        found = H._candidates(block, block.unit[a], focus, block.norms[a], threshold)
        reach = set(np.flatnonzero(block.scores(None, block.q[a], block.largest) >= threshold))
        if found is not None:
            assert reach <= set(found)
            pruned += len(found) < len(block.nodes)
    assert pruned


def test_buckets_fall_in_length_and_lists_are_sorted(spark):
    frame = spark.createDataFrame(vectors(4, 900, 5), SCHEMA)
    blocks = [H._Block(r.asDict()) for r in H.length_buckets(H.whole_vectors(frame)).orderBy("bucket").collect()]
    assert len(blocks) > 1 and sum(len(b.nodes) for b in blocks) == 900
    for before, after in zip(blocks, blocks[1:]):
        assert before.norms.min() >= after.longest
    for block in blocks:
        for f in range(block.width):
            assert (np.diff(block.unit[block.orders[f], f]) >= 0).all()
