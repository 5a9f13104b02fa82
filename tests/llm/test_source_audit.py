import random
import re
from collections import Counter, defaultdict

import pytest

from priceboard.llm import source_audit as sa

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_df, top=10):
    docs = [(r[2] or "", r[3] or "", [t.translate(str.maketrans(sa.UPPER, sa.LOWER)) for t in TERM.findall(r[1] or "")]) for r in rows]
    df, n, seen = Counter(), defaultdict(Counter), set()
    for lang, source, ts in docs:
        df.update((lang, t) for t in set(ts))
        n[lang, source].update(ts)
        seen.add((lang, source))
    out = []
    for lang in {x for x, _ in seen}:
        v = [t for (x, t), c in df.items() if x == lang and c >= min_df]
        own = {s: n[lang, s] for x, s in seen if x == lang}
        whole = sum(own.values(), Counter())

        def share(c):
            words = sum(c[t] for t in v)
            return {t: 1 + 10**9 * (c[t] + 2) // (words + 2 * len(v)) for t in v}

        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in v)) for o in own if o != s]
            marks = [(t, apart(p[s][t], q[t])) for t in v if own[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", marks, top)):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(order)]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def corpus(n, seed, sources=5, langs=("en", "de", None)):
    rng = random.Random(seed)
    words = ["Alpha", "béta", "É", "x", "gamma-delta", "w1w2", "Ünder", "日本", "𝔘", "d'or", *(f"q{chr(97 + i)}" for i in range(20))]
    return [(i, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(0, 30))), rng.choice(langs), rng.choice([None, *(f"s{k}" for k in range(sources))])) for i in range(n)]


@pytest.mark.parametrize("min_df, most_terms, tile", [(10, sa.MOST_TERMS, 128), (3, 40, 2), (2, 7, 1)])
def test_against_brute_force(spark, min_df, most_terms, tile):
    """Also with vocabularies in several slices and sources in several tiles."""
    rows = corpus(150, min_df) + [(900, None, "en", "only null"), (901, "", "fr", "a"), (902, "rare", "fr", "b"), (903, "\x00 1 2", "en", "blank")]
    docs = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    assert got(sa.audit(docs, min_df=min_df, most_terms=most_terms, tile=tile)) == brute(rows, min_df)


def test_repeated_rows_and_ties(spark):
    rows = [(i, "b a", "en", s) for i in range(6) for s in ("x", "y")] * 2
    docs = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    want = brute(rows, 10)
    assert got(sa.audit(docs)) == want and {r[4] for r in want if r[2] == "pair"} == {0}


def test_no_kept_terms_empty_table_and_other_columns(spark):
    rows = [(1, "one two", "en", "a"), (2, "", "en", "b"), (3, None, None, None)]
    docs = spark.createDataFrame([(*r, 7, "t") for r in rows], SCHEMA + ", tokens string")
    assert got(sa.audit(docs)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)] == brute(rows, 10)
    assert sa.audit(docs.limit(0)).collect() == []


def test_very_long_text(spark):
    rows = [(i, "long text " * (100_000 if i == 3 else 1) + f"s{i % 2}", "en", f"s{i % 2}") for i in range(24)]
    docs = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    assert got(sa.audit(docs)) == brute(rows, 10)


def test_shares_are_exact_beyond_64_bits(spark):
    n, words, kept = 7 * 10**14 + 13, 9 * 10**17 + 1, 12345
    df = spark.createDataFrame([(n, words, kept)], "n long, words long, kept long")
    from pyspark.sql import functions as F

    assert df.select(sa._share(F.col("n"))).first()[0] == 1 + 10**9 * (n + 2) // (words + 2 * kept)


def test_model_and_vectors_are_exact_and_sparse(spark):
    docs = sa.documents(spark.createDataFrame([(*r, None) for r in corpus(60, 1)], SCHEMA))
    made, vocabulary, langs = sa.vectors(docs, min_df=5)
    assert made.count() == 60 and vocabulary.groupBy("lang_no", "term").count().filter("count > 1").isEmpty() and langs.count() == 3
    total = made.selectExpr("aggregate(values, 0D, (a, x) -> a + x) AS n", "size(values) AS distinct").selectExpr("sum(n)", "max(distinct)").first()
    assert total[0] == int(total[0]) and total[1] <= 30
