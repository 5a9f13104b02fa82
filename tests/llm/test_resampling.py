import math
import random
from collections import Counter

import xxhash

from priceboard.llm import resampling as rs


def test_good_texts_are_selected(spark, make, prose):
    rng = random.Random(8)
    rows = [(i, prose(rng, 80) if i % 4 else " ".join(rng.choice(["zz%", "qq$", "xx#"]) + str(rng.randint(0, 99)) for _ in range(80))) for i in range(400)]
    rows += [(900, None), (901, ""), (1, rows[1][1])]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 2)], "doc_id long, quality int")
    got = rs.resample(make(rows), labels).collect()
    assert len(got) == len(rows)
    good = [r for r in got if r["id"] < 400 and r["id"] % 4]
    bad = [r for r in got if r["id"] < 400 and not r["id"] % 4]
    assert min(r["log_weight"] for r in good) > max(r["log_weight"] for r in bad)
    k = -(-len(rows) // 2)
    assert k <= sum(r["selected"] for r in got) <= k + 1  # equal rows have equal keys
    assert {r["id"]: r["log_weight"] for r in got}[900] == 0


def test_kth_largest(spark):
    rng = random.Random(9)
    v = [rng.choice([rng.gauss(0, 1), 0.5, 1e9 * rng.random()]) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    for k in (1, 2, 250, 499, 500):
        assert rs.kth_largest(df, "x", k) == sorted(v, reverse=True)[k - 1]


def test_no_labels_no_rows(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["log_weight"] for r in rs.resample(make([(1, "a b"), (2, "c")]), none).collect()] == [0, 0]
    assert rs.resample(make([]), none).collect() == []


def brute(rows, good, k):
    """Weights by the definition, with plain numbers; selected ids of the k largest keys are checked from the keys."""
    mask = 2**64 - 1

    def final(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def grams(text):
        h = [xxhash.xxh3_64_intdigest(w.encode()) for w in (text or "").lower().split()]
        return [final(x) % rs.BUCKETS for x in h] + [final((a * 0x9E3779B97F4A7C15 + b) & mask) % rs.BUCKETS for a, b in zip(h, h[1:], strict=False)]

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    n, m = sum(raw.values()) + rs.BUCKETS, sum(target.values()) + rs.BUCKETS
    return [sum(math.log((target[g] + 1) / m) - math.log((raw[g] + 1) / n) for g in grams(t)) for _, t in rows]


def test_weights_and_selection_against_brute_force(spark, make, prose):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([1, 2, 9, 60, 300]))) for i in range(60)] + [(100, None), (101, ""), (7, "ties are here"), (8, "ties are here"), (None, "no id")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40)] + [(3, None), (None, 1), (4, 1), (5, 1)], "doc_id long, quality int")
    good = {i for i in range(1, 40, 2)} | {4}
    got = rs.resample(make(rows), labels, share=0.3).collect()
    want = brute(rows, good, 0)
    by = lambda x: (str(x[0]), round(x[1], 6))
    assert sorted((by((r["id"], r["log_weight"])) for r in got)) == sorted(by((i, w)) for (i, _), w in zip(rows, want, strict=True))
    keys = sorted((r["key"] for r in got), reverse=True)
    k = math.ceil(0.3 * len(rows))
    assert all(r["selected"] == (r["key"] >= keys[k - 1]) for r in got)


def test_noise_is_gumbel(spark, make):
    """Without any evidence the keys are Gumbel noise: mean 0.577, variance pi^2 / 6, and the seed changes them."""
    import numpy as np

    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = make([(i, "same text") for i in range(4000)])
    a, b = ({r["id"]: r["key"] for r in rs.resample(docs, none, share=0.5, seed=s).collect()} for s in (0, 1))
    x = np.array(list(a.values()))
    assert abs(x.mean() - 0.5772) < 0.08 and abs(x.var() - math.pi**2 / 6) < 0.25 and abs(np.corrcoef(x, [b[i] for i in a])[0, 1]) < 0.06


def test_clashing_columns_and_a_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000, 1.0, "g", "x"), (2, "other", 2.0, "h", "y")], "doc_id long, text string, u double, good string, key string")
    labels = spark.createDataFrame([(1, 1, "x")], "doc_id long, quality int, id string")
    got = {r["id"]: r for r in rs.resample(docs, labels).collect()}
    assert got[1]["selected"] and got[2]["selected"] and got[1]["log_weight"] != got[2]["log_weight"]
