import random

import numpy as np
import pytest

from priceboard.operators.click_debounce import debounce, entries

SCHEMA = "session_id string, label string, ms long, id long"


def brute(rows, gap):
    kept, last = [], {}
    for s, label, ms, i in sorted(rows, key=lambda r: (r[2], r[3])):
        k = last.get(s)
        if k is None or label is None or k[0] != label or ms - k[1] >= gap:
            kept.append((s, i))
            last[s] = (label, ms)
    return sorted(kept, key=str)


def run(spark, rows, gap, block):
    return sorted(((r["session_id"], r["id"]) for r in debounce(spark.createDataFrame(rows, SCHEMA), gap, block).collect()), key=str)


@pytest.mark.parametrize("gap, block, labels, spread", [(2000, 40, 2, 100_000), (2000, 25, 1, 60_000), (300, 30, 1, 900), (5000, 15, 1, 9_000), (100, 1000, 3, 5_000)])
def test_hot_session_in_many_blocks(spark, gap, block, labels, spread):
    """A session with a third of all clicks: blocks that wait as a whole, and blocks shorter than the gap that are passed over."""
    rng = random.Random(gap + block)
    rows = [("hot", f"l{rng.randrange(labels)}", 1_700_000_000_000 + rng.randrange(spread), i) for i in range(300)]
    rows += [(rng.choice([None, "a", "zz", *(f"s{k}" for k in range(30))]), rng.choice(["l0", "l1", None]), 1_700_000_000_000 + rng.randrange(spread), i) for i in range(300, 900)]
    rows += [("hot", "l0", 1_700_000_000_000 + spread // 2, i) for i in range(900, 940)]  # ties of time
    assert run(spark, rows, gap, block) == brute(rows, gap)


def test_one_session_alone(spark):
    rng = random.Random(9)
    rows = [("hot", "l", 10 * i + rng.randrange(9), i) for i in range(800)]
    for gap, block in ((95, 20), (333, 20), (10_000, 50), (1, 20)):
        assert run(spark, rows, gap, block) == brute(rows, gap)


def test_small_cases(spark):
    assert debounce(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [("a", None, 1, 1), ("a", None, 1, 2), ("a", "x", 1, 3), ("a", "x", 2000, 4), ("a", "x", 2001, 5), (None, "x", 0, 6), (None, "x", 1, 7)]
    assert run(spark, rows, 2000, 2) == brute(rows, 2000)


def test_entries():
    rng = np.random.default_rng(1)
    for _ in range(200):
        ms = np.sort(rng.integers(0, 200, rng.integers(1, 60)))
        gap = int(rng.integers(1, 80))
        first, last = entries(ms, gap)
        for f, z in zip(first, last):
            t = f
            while len(on := ms[ms >= t + gap]):
                t = on[0]
            assert t == z
        assert set(first) >= {x for x in ms if x < ms[0] + gap}
