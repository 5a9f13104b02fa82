import random
from collections import Counter

from priceboard.llm import quality_rules as qr


def brute(text):
    t = text or ""
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    fail = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), fail


def rows(prose):
    rng = random.Random(7)
    out = [(i, prose(rng, rng.randint(12, 400)), rng.choice(["en", "en", "fr", None]), rng.choice(["a", "a", "b"])) for i in range(400)]
    junk = [(1000 + i, " ".join(x + "%%%&&&" for x in prose(rng, 100).split()), "en", "a") for i in range(20)]
    line = prose(rng, 8)
    edge = [(2000, None, None, None), (2001, "", "en", "a"), (2002, " \t\n\x0b ", "en", "a"), (2003, "\n".join([line] * 9), "en", "a"), (2004, "a b c d e a b c d e", "en", "zz"), (2005, "é" * 50000, "en", "a"), (2006, "w " * 20000, "en", "a"), (3, out[3][1], "en", "a")]
    return out + junk + edge


def test_counts_and_verdicts(make, prose):
    data = rows(prose)
    got = qr.judge(make(data), columns=["doc_id", "text"], min_docs=30).select("__row.*", "__nw", "__wc", "__sym", "__dup", "__rep", "__fail", "__kept").collect()
    assert len(got) == len(data)
    for r in got:
        assert tuple(r)[2:8] == brute(r["text"]), r["doc_id"]
        assert not (r["__fail"] and r["__kept"])
    clean = [r for r in got if r["doc_id"] < 400 and not r["__fail"]]
    assert sum(r["__kept"] for r in clean) >= 0.99 * len(clean)
    assert not any(r["__kept"] for r in got if 1000 <= r["doc_id"] < 1020)


def test_pipeline_form_and_empty(make, prose):
    docs = make(rows(prose)[:50])
    out = qr.quality_rules(docs)
    assert out.columns == docs.columns and out.count() == 50
    assert qr.quality_rules(make([])).collect() == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, "x")], "doc_id long, text string, lang string, source string, g int, d2 string")
    assert qr.judge(docs).first()["__kept"] is False


def test_junk_of_any_length_among_texts_without_symbols(make, prose):
    rng = random.Random(8)
    clean = [(i, prose(rng, rng.randint(12, 400)), "en", "a") for i in range(400)]
    marked = lambda n, k: " ".join(w + "%%%&&&"[: (j + 1) * k // n - j * k // n] for j, w in enumerate(prose(rng, n).split()))
    junk = [(1000, marked(34, 30)), (1001, marked(15, 15))] + [(1002 + i, " ".join(w + " |" for w in prose(rng, n).split())) for i, n in enumerate([40, 60, 90, 120])]
    got = qr.judge(make(clean + [(*x, "en", "a") for x in junk]), columns=["doc_id"]).select("__row.doc_id", "__kept", "__fail").collect()
    assert not [r for r in got if r["doc_id"] >= 1000 and r["__kept"]]
    passed = [r for r in got if r["doc_id"] < 1000 and not r["__fail"]]
    assert sum(r["__kept"] for r in passed) >= 0.99 * len(passed)


def brute_mcd(x, floors, tries=300, seed=1):
    """The half of least determinant over many random starts, with the same floors: log determinant, and the reweighted distances."""
    import numpy as np

    rng, h = np.random.default_rng(seed), (len(x) + 1) // 2

    def factor(c):
        low = np.zeros_like(c)
        for j in range(len(c)):
            low[j, j] = np.sqrt(max(c[j, j] - low[j, :j] @ low[j, :j], floors[j] ** 2))
            for i in range(j + 1, len(c)):
                low[i, j] = (c[i, j] - low[i, :j] @ low[j, :j]) / low[j, j]
        return low

    d2 = lambda m, low: (np.linalg.solve(low, (x - m).T) ** 2).sum(axis=0)
    best = None
    for _ in range(tries):
        pick, last = rng.choice(len(x), len(floors) + 2, replace=False), np.inf
        while True:
            m, low = x[pick].mean(axis=0), factor(np.cov(x[pick].T, bias=True))
            det = 2 * np.log(np.diag(low)).sum()
            if len(pick) == h and det > last - 1e-9:
                break
            last = det if len(pick) == h else np.inf
            pick = np.argsort(d2(m, low), kind="stable")[:h]
        if best is None or det < best[0]:
            best = det, m, low
    det, m, low = best
    d = d2(m, low)
    pick = d / max(1.0, np.median(d) / qr.MEDIAN_CHI2) <= qr.REWEIGHT_CHI2
    return det, d2(x[pick].mean(axis=0), factor(np.cov(x[pick].T, bias=True)))


def test_determinants_against_many_random_starts(spark):
    """Correlated statistics with a third of outliers in one cluster, and a group with constant statistics."""
    import numpy as np

    rng, floors = np.random.default_rng(4), np.array(list(qr.FEATURES.values()))
    mixing = rng.normal(size=(6, 6))
    good = rng.normal(size=(400, 6)) @ mixing
    bad = rng.normal(size=(180, 6)) * 0.3 + 60 * mixing[0] + 40
    flat = np.where(np.arange(6) < 3, rng.normal(size=(300, 6)), 1.0)
    groups = {"a": np.concatenate([good, bad]), "b": flat}
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    vectors = spark.createDataFrame(rows, ["g", *qr._names()])
    raw = {r["g"]: r["det"] for r in qr.least_determinants(vectors, True).collect()}
    final = {g: [r["d2"] for r in qr._distance(vectors.join(qr.estimates(vectors, True), "g")).filter(f"g = '{g}'").orderBy(*qr._names()).collect()] for g in groups}
    for g, x in groups.items():
        det, d2 = brute_mcd(x, floors)
        assert raw[g] <= det + 0.05, (g, raw[g], det)
        mine, theirs = np.array(final[g]), d2[np.lexsort(x.T[::-1])]
        assert ((mine > qr.CUTOFF) == (theirs > qr.CUTOFF)).mean() > 0.99
    assert (np.array(final["a"]) > qr.CUTOFF).sum() >= 175


def test_ties_and_no_statistic_beyond_its_floor(make):
    """Repeated rows only: nothing is an outlier."""
    docs = make([(i, "ten words make a row of this table and more", "en", "a") for i in range(50)])
    assert qr.quality_rules(docs, min_docs=10).count() == 50


def test_very_long_text(make, prose):
    long = prose(random.Random(2), 150_000)
    docs = [(i, prose(random.Random(i), 120), "en", "s") for i in range(60)] + [(100, long, "en", "s"), (101, "word " * 100_000, "en", "s"), (102, long, "en", "s")]
    got = {r["__row"]["doc_id"]: r for r in qr.judge(make(docs), columns=["doc_id"]).collect()}
    assert got[100]["__nw"] == len(long.split()) and got[100]["__wc"] == sum(map(len, long.split())) and got[101]["__fail"] and not got[101]["__kept"]
    assert {k: v for k, v in got[100].asDict().items() if k != "__row"} == {k: v for k, v in got[102].asDict().items() if k != "__row"}
