import math
import random
import zlib
from collections import Counter

import numpy as np

from priceboard.llm import language_model as lm
from priceboard.llm.elias_fano import EliasFano, mapped


def test_elias_fano_against_a_sorted_list():
    rng = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 5), (50, 60), (3000, 10**6), (2000, 2**64 - 1), (700, 700)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        e = EliasFano.of(v, top)
        if n:
            e = EliasFano(*mapped([e.low, e.high, e.ones]), e.n, e.width)
        assert e.get(np.arange(n)).tolist() == v.tolist()
        q = np.concatenate([v[::3], rng.integers(0, top, 200, dtype=np.uint64, endpoint=True)])
        at, hit = e.find(q)
        assert (hit == np.isin(q, v)).all()
        if n:
            assert (at == np.searchsorted(v, q, side="left")).all()


def rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(80)]
    out = [(i, " ".join(rng.choice(vocabulary[: rng.choice([5, 80])]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    return out + [(900, None), (901, ""), (902, "Only UNKNOWN words\there"), (903, "w1 " * 4000), (7, out[7][1])]


def brute(docs):
    tokens = [(i, (t or "").encode().lower().split() + [lm.END]) for i, t in docs]
    one, two = Counter(), Counter()
    for i, w in tokens:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(w)
            two.update(zip([lm.END, *w], w))
    n, v = sum(one.values()), len(one)
    prior = lambda x: lm.PRIOR * max(one[x], n / lm.HOT)
    out = []
    for i, w in tokens:
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10((two[a, b] + prior(a) * (one[b] + 1) / (n + v + 1)) / (one[a] + prior(a))) for a, b in zip([lm.END, *w], w))
        out.append((i, zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


def test_scores_against_brute_force(make):
    got = sorted(map(tuple, lm.score(make(rows())).collect()), key=str)
    want = sorted(brute(rows()), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5]))
        assert abs(g[6] - w[6]) < 0.02 * max(1, w[2])  # quantised to 256 levels


def test_probabilities_sum_to_one():
    docs = [(0, "a b a c"), (1, "b a"), (3, "c c a b")]
    one, two = Counter(), Counter()
    for _, t in docs:
        w = [*t.split(), "$"]
        one.update(w)
        two.update(zip(["$", *w], w))
    n, v = sum(one.values()), len(one)
    m = lm.PRIOR * max(one["a"], n / lm.HOT)
    total = sum((two["a", w] + m * (one[w] + 1) / (n + v + 1)) / (one["a"] + m) for w in [*one, "unknown"])
    assert abs(total - 1) < 1e-12


def test_empty_and_null_keys(make):
    assert lm.score(make([])).collect() == []
    r = lm.score(make([(None, "a b"), (None, "a b")])).collect()
    assert [x["held_out"] for x in r] == [False, False] and [x["n_known"] for x in r] == [3, 3]


def test_many_hot_words_and_clashing_columns(spark):
    """All words are hot in a small corpus: none is forgotten, whatever the number of shuffle partitions."""
    rows = [(i, " ".join(f"v{(i * 7 + k) % 6000}" for k in range(60)), 1, "x", 2) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held int, pack string, shard int")
    got = sorted(map(tuple, lm.score(docs).collect()), key=str)
    want = sorted(brute([r[:2] for r in rows]), key=str)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and abs(g[6] - w[6]) < 0.02 * max(1, w[2])
