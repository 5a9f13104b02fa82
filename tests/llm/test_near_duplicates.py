import random
from collections import Counter

import numpy as np
import pytest

from priceboard.llm import near_duplicates as nd


def exact(a, b):
    """Probability Jaccard index by its definition."""
    s = []
    for t in (a, b):
        w = (t or "").split()
        s.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    x, y = s
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in set(x) & set(y)) if keys else 1.0


def corpus(prose):
    rng = random.Random(10)
    rows, n = [], 0
    for g in range(40):
        base = prose(rng, rng.choice([6, 30, 150, 400])).split(" ")
        for _ in range(rng.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = f"new{rng.randint(0, 999)}"
            rows.append((n, " ".join(t), "en", f"s{g % 3}"))
            n += 1
    line = prose(rng, 20)
    return rows + [(800, f"{line}\n" * 9), (801, f"{line}\n" * 12), (900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one two"), (905, "one  two"), (5, rows[5][1])]


def test_similarity_by_definition(prose):
    rows = corpus(prose)
    words = nd.WordHash()
    for i in range(0, len(rows) - 1, 3):
        a, b = rows[i][1], rows[i + 1][1]
        f = lambda t: nd.shingles([(t or "").encode()], words)[:2]
        assert abs(nd.similarity(*f(a), *f(b)) - exact(a, b)) < 1e-9


def test_sketch_estimates_the_index():
    rng = np.random.default_rng(1)
    e = rng.integers(1, 2**63, 400, dtype=np.uint64)
    w = rng.integers(1, 5, 400).astype(float)
    a, b = np.arange(0, 300), np.arange(100, 400)
    doc = np.concatenate([np.zeros(300, int), np.ones(300, int)])
    sig = nd.prob_min_hash(np.concatenate([e[a], e[b]]), np.concatenate([w[a], w[b]]), doc, 2, 4096)
    s1, s2 = sorted(range(300), key=lambda i: e[a][i]), sorted(range(300), key=lambda i: e[b][i])
    true = nd.similarity(e[a][s1], w[a][s1], e[b][s2], w[b][s2])
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def test_classes_against_all_pairs(make, prose):
    rows = corpus(prose)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1] or "", rows[j][1] or ""
            if a == b or (a.split() and b.split() and exact(a, b) >= 0.8):
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        low[root(i)] = min(low.get(root(i), r[0]), r[0])
    want = sorted((r[0], low[root(i)]) for i, r in enumerate(rows))
    got = nd.near_duplicates(make(rows))
    assert sorted((r["doc_id"], r["class_id"]) for r in got.collect()) == want
    kept = nd.one_of_each(make(rows))
    assert kept.columns == make([]).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(low.values())


def test_empty_and_null_keys(make):
    assert nd.near_duplicates(make([])).collect() == []
    assert nd.one_of_each(make([])).collect() == []
    got = nd.one_of_each(make([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")])).collect()
    assert [r["doc_id"] for r in got] == [3]


@pytest.mark.parametrize("n", [1, 2, 60])
def test_components_of_a_path_and_a_star(spark, n):
    path = [(i, i + 1) for i in range(n)]
    star = [(1000, 1000 + i) for i in range(1, n + 1)]
    got = {r["k"]: r["c"] for r in nd.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1000 + i: 1000 for i in range(1, n + 1)}


def partition(rows, least=0.8):
    """Least id of the class of each row, by all pairs."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1] or "", rows[j][1] or ""
            if root(i) != root(j) and (a == b or (a.split() and b.split() and exact(a, b) >= least)):
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return sorted((r[0], low[root(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("frequent", [2, 1000])
def test_groups_around_the_threshold_against_all_pairs(make, prose, monkeypatch, frequent):
    """A passage that all share with more or less of their own, and looser and closer copies of one text."""
    monkeypatch.setattr(nd, "FREQUENT", frequent)
    rng = random.Random(5)
    passage, base, rows = prose(rng, 45), prose(rng, 60).split(" "), []
    for i in range(60):
        rows.append((i, f"{prose(rng, rng.randint(1, 12))} {passage} {prose(rng, rng.randint(1, 6))}"))
    for i in range(60, 110):
        t = list(base)
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = f"new{i}x{rng.randint(0, 99)}"
        rows.append((i, " ".join(t)))
    got = nd.near_duplicates(make(rows)).collect()
    want = partition(rows)
    assert 20 < len({c for _, c in want}) < 110
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == want


def test_rare_pairs_are_all_pairs(spark, prose):
    """Without any sketch: every pair at the threshold is met, and only few others."""
    rng = random.Random(8)
    passage, texts = prose(rng, 40), []
    for i in range(80):
        texts.append(f"{prose(rng, rng.randint(0, 9))} {passage} {'again and again ' * rng.choice([0, 0, 1, 2])}x{i} y{i}")
    frame = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "k long, text binary")
    got = {(r["a"], r["b"]) for r in nd.rare_pairs(frame, frame.selectExpr("k", "k as c"), 0.8).collect()}
    want = {(i, j) for j in range(80) for i in range(j) if exact(texts[i], texts[j]) >= 0.8}
    assert want and want <= got


def test_clashing_columns_and_a_low_threshold(spark):
    wide = spark.createDataFrame([(1, "a b c d e f", 1, 2, "x"), (2, "a b c d e f", 3, 4, "y")], "doc_id long, text string, k long, c long, __row string")
    assert [r["class_id"] for r in nd.near_duplicates(wide).collect()] == [1, 1]
    assert nd.one_of_each(wide).collect() == wide.filter("doc_id = 1").collect()
    with pytest.raises(ValueError):
        nd.near_duplicates(wide, threshold=0.5)


def test_very_long_text(make, prose):
    t = prose(random.Random(2), 60_000)
    got = nd.near_duplicates(make([(1, t), (2, t + " end"), (3, "other words than these are")])).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == [(1, 1), (2, 1), (3, 3)]
