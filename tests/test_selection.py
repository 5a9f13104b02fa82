import random
import statistics

import pytest

from priceboard.operators import board, robust, selection

SCHEMA = "a string, b int, v double"


def values(seed):
    rng = random.Random(seed)
    rows = [("hot", 1, rng.choice([0.0, 1e-300, 1e300, -1e300, rng.lognormvariate(0, 40), -rng.random(), 7.0, 7.0, 7.0])) for _ in range(900)]
    rows += [("hot", None, rng.gauss(1e6, 1e-3)) for _ in range(701)] + [(None, 1, float(i % 2)) for i in range(500)] + [("same", 3, 5.5)] * 300
    return rows + [("one", 1, 3.0), ("two", 1, 3.0), ("two", 1, 4.0), ("none", 1, None), ("some", 1, None), ("some", 1, 2.0)]


def want(rows, key):
    by = {}
    for r in rows:
        by.setdefault(key(r), []).extend([] if r[2] is None else [r[2]])
    return {k: (statistics.median(v) if v else None, len(v)) for k, v in by.items()}


@pytest.mark.parametrize("limit", [2, 40, 10_000])
def test_all_groups_at_once(spark, limit):
    rows = values(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["a"], r["b"]): (r["m"], r["n"]) for r in selection.medians(df, ["a", "b"], "v", limit).collect()}
    assert got == want(rows, lambda r: (r[0], r[1]))
    whole = selection.medians(df, [], "v", limit).first()
    assert (whole["m"], whole["n"]) == want(rows, lambda r: 0)[0]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert selection.medians(df, ["a"], "v", 1).collect() == [] and tuple(selection.medians(df, [], "v", 1).first()) == (None, 0)


def test_no_task_gathers_a_group(spark, monkeypatch):
    """With a small limit the boards and scores come out the same, and no aggregate of a whole group's values is planned."""
    rng = random.Random(3)
    rates = spark.createDataFrame([(f"n{i}", rng.gauss(9000, 300), i % 3 > 0, ["X"]) for i in range(400)], "name string, canonical double, national boolean, states array<string>")
    offers = spark.createDataFrame([(f"b{i % 2}", rng.gauss(10, 1) if i % 50 else 99.0) for i in range(600)], "brand string, pct double")
    plain = board.market_snapshot(rates).first(), sorted(map(str, robust.mad_scores(offers, ["brand"], "pct").collect())), robust.summarize(offers, ["brand"], "pct").orderBy("brand").collect()
    monkeypatch.setattr(selection.medians, "__defaults__", (20,))
    narrow = board.market_snapshot(rates).first(), sorted(map(str, robust.mad_scores(offers, ["brand"], "pct").collect())), robust.summarize(offers, ["brand"], "pct").orderBy("brand").collect()
    assert plain == narrow
    plan = selection.medians(offers, ["brand"], "pct")._jdf.queryExecution().analyzed().toString()
    assert "median(" not in plan


def test_one_row(spark):
    two = spark.range(2)
    assert board.one_row(two.filter("id = 1")).first()["id"] == 1 and board.one_row(two.filter("id > 5")).collect() == []
    with pytest.raises(Exception, match="one row expected"):
        board.one_row(two).collect()
