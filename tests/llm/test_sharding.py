from collections import Counter

import pytest

from priceboard.llm import sharding as sh


def test_shares_and_disruption():
    names = [f"n{i}" for i in range(7)]
    a = sh.lookup(names, 1009)
    n = Counter(a)
    assert len(a) == 1009 and max(n.values()) - min(n.values()) <= 1
    b = sh.lookup(names[:-1], 1009)
    stay = sum(x == y for x, y in zip(a, b) if x != 6)
    assert stay > 0.75 * sum(x != 6 for x in a)
    for bad in ((names, 1000), ([], 7), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            sh.lookup(*bad)


def test_placement_against_the_table(spark, make):
    import hashlib

    rows = [(i, f"t{i}") for i in range(200)] + [(None, "x"), (None, None), (3, "t3")]
    table = sh.lookup([f"shard-{i}" for i in range(5)], 101)
    got = sh.shard(make(rows), 5, 101).collect()
    assert len(got) == len(rows)
    for r in got:
        key = str(r["doc_id"]) if r["doc_id"] is not None else hashlib.md5((r["text"] or "").encode()).hexdigest()
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    clash = spark.createDataFrame([(1, "a", "old")], "doc_id long, text string, shard string")
    assert sh.shard(clash, 5, 101).columns == ["doc_id", "text", "slot", "shard"]
    assert sh.shard(make([])).collect() == []


def test_no_python_in_the_plan(make):
    plan = sh.shard(make([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a", 7, 8, "r", 1.5)], "doc_id long, text string, __slot int, __shard int, __row string, `a.b` double")
    got = sh.shard(rows, 5, 101)
    assert got.columns == [*rows.columns, "slot", "shard"] and tuple(got.first())[:6] == (1, "a", 7, 8, "r", 1.5)


def test_very_long_text_and_ties(make):
    got = sh.shard(make([(None, "word " * 400_000), (None, "word " * 400_000), (5, None), (5, "x")]), 5, 101).collect()
    assert got[0]["slot"] == got[1]["slot"] and len({r["slot"] for r in got if r["doc_id"] == 5}) == 1
