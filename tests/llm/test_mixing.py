import random

import pytest

from priceboard.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, capped, want = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = want - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = [s for s in free if target[s] > most * sizes[s] + 1e-9]
        if not over:
            return target
        capped |= set(over)


def rows():
    rng = random.Random(1)
    out = [(i, " ".join(f"w{i}_{k}" for k in range(rng.choice([0, 1, 7, 40, 300]))), "en", rng.choice(["a", "a", "a", "b", "Z", "é", None])) for i in range(120)]
    out += [(None, "no id here", "en", "a"), (5000, None, "en", "b"), (5001, "", None, "only-empty"), (5002, "twice the same", "en", "b"), (5002, "twice the same", "en", "b")]
    return out


def test_targets_and_taken(make):
    docs = make(rows())
    got = mixing.taken(docs, block=16, shard_slots=64).collect()
    assert len(got) == len(rows())
    sizes = {}
    for _, t, _, s in rows():
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    by_size = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_size.setdefault(round(r["target"], 6), 0)
        by_size[round(r["target"], 6)] += r["taken"]
        assert any(abs(r["target"] - t) < 1e-6 and r["source_size"] == sizes[s] for s, t in want.items())
    for t, n in by_size.items():
        assert abs(n - sum(x for x in want.values() if abs(x - t) < 1e-6)) <= 2
    again = mixing.taken(docs.repartition(3), block=16, shard_slots=64).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_documents_hold_the_words_taken(make):
    docs = make(rows())
    taken = {}
    for r in mixing.taken(docs, block=16).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns
    words = {}
    original = {r[0]: r[1] for r in rows()}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
        assert set(r["text"].split()) <= set(original[r["doc_id"]].split())
        assert r["n_chars"] == len(r["text"])
    assert words == {k: v for k, v in taken.items() if v}


def test_empty_table(make):
    assert mixing.taken(make([])).collect() == []


def test_permutation_is_one_to_one():
    import numpy as np

    for n in (1, 2, 3, 17, 1000, 4097):
        there = mixing.permutation(np.arange(n), n, 5)
        assert sorted(there.tolist()) == list(range(n))
        assert mixing.permutation(there, n, 5, inverse=True).tolist() == list(range(n)) and there[mixing._place(n, 5)] == n - 1


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 9, 9)], "doc_id long, text string, source string, size int, __size int")
    assert mixing.taken(docs).first()["size"] == 3


@pytest.mark.parametrize("seed", [0, 1])
def test_seed_changes_the_last_pass_only(make, seed):
    docs = make([(i, "x " * 50, "en", "a" if i % 2 else "b") for i in range(40)])
    got = mixing.taken(docs, block=8, seed=seed).collect()
    assert sum(r["taken"] for r in got) == 3000


def test_one_text_in_two_sources(spark):
    """The same id and text in two sources: each source's rows carry its own spans, whatever the order of the rows."""
    text = " ".join(f"w{i}" for i in range(10))
    rows = [(1, text, "A", 1), (1, text, "B", 2), (1, text, "B", 3), (2, "other words here", "C", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __nth int")
    _, spans = mixing.mix(mixing.sized(docs, "text", "source", "doc_id"), block=4)
    want = {r["__source"]: r["n"] for r in spans.groupBy("__source").agg({"__words": "sum"}).withColumnRenamed("sum(__words)", "n").collect()}
    runs = []
    for part in (1, 3):
        got = mixing.mixed_documents(docs.repartition(part), block=4).collect()
        by_source = {}
        for r in got:
            by_source[r["source"]] = by_source.get(r["source"], 0) + len(r["text"].split())
        assert by_source == want and set(want) == {"A", "B", "C"}
        runs.append(sorted(map(tuple, got)))
    assert runs[0] == runs[1]


def test_slots_against_brute_force(spark):
    """Every visit of every block once in each whole pass, and the last pass ends at the target's word."""
    rows = [("a", 100, 170.0), ("b", 33, 66.0), (None, 7, 3.0), ("empty", 0, 0.0)]
    sources = spark.createDataFrame(rows, "__source string, __total long, __target double")
    got = mixing.slots(sources, block=8, shard_slots=6, seed=3).collect()
    for name, total, target in rows:
        mine = [r for r in got if r["__source"] == name]
        assert sum(r["__take"] for r in mine) == round(target)
        blocks = [min(8, total - at) for at in range(0, total, 8)]
        for lap in range(int(target) // total if total else 0):
            assert sorted(r["__block"] for r in mine if r["__pass"] == lap) == list(range(len(blocks)))
        assert len({(r["__pass"], r["__block"]) for r in mine}) == len(mine) and all(r["__take"] <= blocks[r["__block"]] for r in mine)


def test_very_long_text(make):
    n = 200_000
    docs = make([(1, "word " * n, "en", "a"), (2, "x y", "en", "b")])
    got = {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect()}
    assert got[2] == 4 and got[1] == round(1.5 * (n + 2)) - 4
