import random

from priceboard.llm import toxicity as tx


def corpus(prose):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        text, bad = prose(rng, rng.randint(20, 150)), i % 6 == 0
        if bad:
            parts = text.split(" ")
            for w in rng.sample(["vilescum", "vilescumming", "foulmouth", "foulmouthed"], 2):
                parts.insert(rng.randrange(len(parts)), w)
            text = " ".join(parts)
        docs.append((i, text))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_sentences(spark, make, prose):
    docs, labels = corpus(prose)
    lab = spark.createDataFrame([x for x in labels if x[0] % 5] + [(None, 1), (9999, None)], "doc_id long, toxic int")
    model = tx.train(make(docs), lab)
    got = {r["id"]: r for r in tx.score(make(docs + [(500, None), (501, "")]), model, spans=True).collect()}
    held = [i for i, _ in labels if i % 5 == 0]
    right = sum((got[i]["score"] >= 0.5) == bool(labels[i][1]) for i in held)
    assert right >= 0.95 * len(held)
    assert got[500]["score"] == got[501]["score"] == 0
    for i in held:
        if labels[i][1] and got[i]["score"] >= 0.5:
            assert got[i]["offending"] and all("vilescum" in s["sentence"].lower() or "foulmouth" in s["sentence"].lower() for s in got[i]["offending"])


def test_without_labels(spark, make):
    model = tx.train(make([(1, "a b c")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= tx.score(make([(1, "a b c")]), model).first()["score"] < 0.5
    assert tx.score(make([]), model).collect() == []


def test_query_locates_sentences(spark, make, prose, tmp_path):
    from priceboard.llm import queries

    docs, labels = corpus(prose)
    make(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op4_toxicity(spark, str(tmp_path)).collect()
    bad = [r for r in got if r["predicted"] and labels[r["doc_id"]][1]]
    assert bad and any(r["n_offending"] for r in bad) and len({r["offending_md5"] for r in got}) > 1


def test_scores_against_brute_force(spark, make, prose):
    """Noisy-or over sentences, by plain numbers from the weights of a model, for texts with every kind of sentence end."""
    import math
    import re

    rng = random.Random(9)
    texts = [" ".join(w + rng.choice(["", "", "", ".", "!)", '?"', "\n", ","]) for w in prose(rng, rng.randint(1, 60)).split()) for _ in range(60)]
    texts += [None, "", " \n ", "...", "a" * 100_000, texts[0]]
    some = sorted({w for t in texts if t for w in t.lower().split()})
    weights = {f: rng.choice([0.5, 3.0]) for w in rng.sample(some, 40) for f in tx.features(w.encode())[:2]}
    bias = -3.0

    def brute(text):
        keep = 1.0
        for line in (text or "").encode().lower().split(b"\n"):
            sentence, z = False, bias
            for w in line.split():
                sentence, z = True, z + sum(weights.get(f, 0.0) for f in tx.features(w))
                if re.search(rb"[.!?][\"')\]}]*$", w):
                    keep *= 1 - 1 / (1 + math.exp(-z))
                    sentence, z = False, bias
            if sentence:
                keep *= 1 - 1 / (1 + math.exp(-z))
        return 1 - keep

    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in enumerate(texts)], "doc_id long, text string, score double, id string")
    got = {r["id"]: r["score"] for r in tx.score(docs, (weights, bias)).collect()}
    assert all(abs(got[i] - brute(t)) < 1e-9 for i, t in enumerate(texts))


def test_fit_is_at_the_optimum():
    """The penalised likelihood falls for no small change of a weight that keeps it at zero or above."""
    import numpy as np

    rng = np.random.default_rng(2)
    n, k = 300, 6
    sizes = rng.integers(1, 6, n)
    doc = np.repeat(np.arange(n), 3)
    sentence, feature = np.array([rng.integers(sizes[d]) for d in doc]), rng.integers(0, k, len(doc))
    y = np.array([int(np.isin(feature[doc == d], (0, 1)).any()) for d in range(n)])
    y = np.where(rng.random(n) < 0.05, 1 - y, y)

    def loss(w, b):
        total = 0.0
        for d in range(n):
            z = np.full(sizes[d], b)
            np.add.at(z, sentence[doc == d], w[feature[doc == d]])
            s = np.logaddexp(0, z).sum()
            total += -np.log1p(-np.exp(-s)) if y[d] else s
        return total / n + tx.L1 * w.sum()

    w, b = tx.fit(y, sizes, doc, sentence, feature, k)
    best = loss(w, b)
    for i in range(k):
        for step in (0.05, -0.05):
            v = w.copy()
            v[i] = max(0.0, v[i] + step)
            assert loss(v, b) >= best - 1e-4
    assert w[0] > 1 and w[1] > 1 and w[2:].max() < w[:2].min()


def test_labels_that_disagree(spark, make):
    docs = [(i, f"word{i} calm text here" if i % 2 else f"word{i} vilescum text here") for i in range(60)]
    both = [(i, 1 - i % 2) for i in range(60)] + [(i, 0) for i in range(60)]
    model = tx.train(make(docs), spark.createDataFrame(both, "doc_id long, toxic int"))
    again = tx.train(make(docs), spark.createDataFrame(both[::-1], "doc_id long, toxic int"))
    assert model == again and model[0]


def test_sentences_are_those_that_are_scored(prose):
    rng = random.Random(4)
    words = tx._Tokens(lambda t: 0.0)
    for _ in range(200):
        t = "".join(rng.choice(["a", "b.", "c!)", " ", " ", "\n", "\t", "\r", "\x01", ". ", "?\"' ", "x\x0by"]) for _ in range(rng.randint(0, 40))).encode()
        at, sentence, doc = words.sentences([t])
        cut = tx._split(t)
        assert len(cut) == len(doc), t
        per = [0] * len(doc)
        for k in sentence.tolist():
            per[k] += 1
        assert per == [len(x.split()) for x in cut], t


def test_offending_sentences_of_many_in_one_text(spark, make):
    model = ({f: 9.0 for f in tx.features(b"vile")[:1]}, -4.0)
    text = " ".join(("It is vile." if i % 100 == 0 else f"Sentence {i} is calm.") for i in range(20_000))
    got = {r["id"]: r["offending"] for r in tx.score(make([(1, text), (2, "All calm. Here too.")]), model, spans=True).collect()}
    assert [x["sentence"] for x in got[1]] == ["It is vile."] * 200 and got[2] == []


def test_very_long_repeated_and_clashing(spark, make, prose):
    docs, labels = corpus(prose)
    model = tx.train(make(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    long = prose(random.Random(1), 120_000)
    rows = [(1, long), (2, long + " Such a vilescum foulmouth vilescumming foulmouthed."), (3, docs[6][1]), (3, docs[6][1])]
    got = tx.score(make(rows), model, spans=True).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert len(by[3]) == 2 and by[3][0] == by[3][1] and by[3][0]["score"] >= 0.5
    assert by[2][0]["score"] >= 0.5 and any("vilescum" in s["sentence"] for s in by[2][0]["offending"])
    clash = spark.createDataFrame([(6, docs[6][1], 0.5, "x", "y", 1)], "doc_id long, text string, score double, id string, `a.b` string, __row int")
    assert abs(tx.score(clash, model).first()["score"] - by[3][0]["score"]) < 1e-12
