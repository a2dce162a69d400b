import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives as h

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, wanted=5, share=80):
    """rows: (id, label, vector) that take part."""
    q = [(i, lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows]
    by = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (i, lab, a) in enumerate(q):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a, b)), j, other) for m, (j, other, b) in enumerate(q) if m != n and len(a) == len(b)]
        for p, pid, _ in sorted((x for x in scored if x[2] == lab), key=by)[:wanted]:
            window = sorted((x for x in scored if x[2] != lab and share * p <= 100 * x[0] <= 100 * p), key=by)
            out += [(i, pid, k + 1, j, p, s) for k, (s, j, _) in enumerate(window[:wanted])]
    return sorted(out, key=str)


def mined(df, **more):
    found = h.mine(df, F.col("vec_id") % 100 == 0, **more)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 0.3, (3, 6))
    rows = [(k, (centres[k % 3] + rng.normal(0, 0.05, 6)).tolist(), int(k % 3 if k % 7 else (k + 1) % 3)) for k in range(700)]
    rows += [(200, rows[5][1], 2), (200, rows[5][1], 2), (None, rows[6][1], 0), (None, rows[7][1], 1), (-100, rows[8][1], 0)]  # repeated, null and negative ids, ties
    rows += [(10_000, [0.1, 0.2], 0), (10_001, [0.1, 0.3], 0), (10_003, [0.1, 0.2], 1), (300_000, [], 0), (300_001, [], 0), (300_002, [], 1)]
    none = [(400_000, [math.nan] * 6, 0), (400_100, None, 1), (400_200, [0.1, None, 0.1, 0.1, 0.1, 0.1], 0), (400_300, [math.inf] * 6, 0), (400_400, rows[0][1], None), (400_500, [1e12] * 6, 0)]
    df = spark.createDataFrame(rows + none, SCHEMA).withColumn("uid", F.lit(1)).withColumn("dim", F.lit("x")).withColumn("home", F.lit(0))
    got = mined(df)
    assert got == brute([(i, lab, v) for i, v, lab in rows]) and len(got) > 100
    assert any(x[1] is None for x in got) or any(x[3] is None for x in got)


def test_many_tiles_and_rounds(spark):
    """A hot label of several chunks, pools of small ones, blocks of more than a chunk, heaps merged over several rounds: the result is the same."""
    rng = np.random.default_rng(6)
    rows = [(k, np.round(rng.normal(0, 0.2, 3), 2).tolist(), 0 if k % 3 == 0 else int(k % 40)) for k in range(9000)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([(i, lab, v) for i, v, lab in rows])
    assert mined(df) == want
    assert mined(df, chunk_bytes=1, block=16, fan=3) == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mined(df) == [] and h.mine(df, F.lit(True)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mined(spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 2)], SCHEMA)) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 70), st.integers(0, 70), st.integers(0, 70), st.integers(0, 2**32))
def test_product(m, k, n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(2**28), 2**28, (m, k)), rng.integers(-(2**28), 2**28, (k, n))
    assert (h.product(a, b) == a @ b).all()


def test_product_wraps_inside_only():
    """Sums of the recursion go beyond 64 bits here, the products themselves don't."""
    a = np.full((33, 33), 2**61, np.int64)
    b = np.zeros((33, 33), np.int64)
    b[0] = 3
    assert (h.product(a, b) == 3 * 2**61).all()


@pytest.mark.parametrize("entries", [0, 1, 200])
def test_heaps_merge_in_any_order(entries):
    rng = np.random.default_rng(entries)
    rows = np.stack([rng.integers(0, 4, entries), rng.integers(0, 2, entries), rng.integers(-3, 3, entries), rng.integers(0, 9, entries), rng.integers(0, 2, entries)])
    pick = lambda x: x[:, h.cut(*x, 5)]
    at = entries // 3
    parts = pick(np.concatenate([pick(rows[:, :at]), pick(rows[:, at:])], axis=1))
    assert (parts == pick(rows)).all()
    count = defaultdict(int)
    for a, s, *_ in pick(rows).T.tolist():
        count[a, s] += 1
    assert all(n <= 5 for n in count.values())
