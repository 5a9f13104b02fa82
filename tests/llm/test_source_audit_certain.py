from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F
from test_source_audit import SCHEMA, brute, corpus, got

from priceboard.llm import source_audit as sa


def test_certain_terms_come_from_no_text(spark):
    """Terms of min_df documents of one task are certain, and the fit gets each in min_df rows of their own."""
    rows = spark.createDataFrame([(0, "s", "a b"), (0, "s", "a a c"), (1, "s", "b"), (1, None, "B"), (0, None, "")], "lang_no int, source string, text string").coalesce(1)
    certain = sa._certain(rows, 2)
    assert certain == {0: b"a", 1: b"b"} and sa._certain(rows.limit(0), 2) == {}
    given = sa.tokens(rows, 2, certain=certain).select("tokens").unionByName(sa._certain_tokens(spark, certain, 2, 0, 1))
    assert Counter(t for r in given.collect() for t in r["tokens"]) == {"0a": 2, "1b": 2, "0b": 1, "0c": 1}
    parts = [Counter(t for r in sa._certain_tokens(spark, certain, 3, k, 2).collect() for t in r["tokens"]) for k in range(2)]
    assert sum(parts, Counter()) == {"0a": 3, "1b": 3}


def test_certain_terms_of_several_rows_and_bounds(spark, monkeypatch):
    """Wherever the search for certain terms ends, the result is that of brute force."""
    rows = corpus(90, 8)
    docs = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    for name, value in (("CERTAIN_BYTES", 200), ("BLOCK_BYTES", 50), ("CERTAIN_ROW", 2)):
        monkeypatch.setattr(sa, name, value)
    assert got(sa.audit(docs, min_df=3)) == brute(rows, 3)


def test_shares_at_the_bound_of_long_integers(spark):
    counts = [0, 5, sa.LONG_COUNT - 1, sa.LONG_COUNT, sa.LONG_COUNT + 1, 10**15]
    df = spark.createDataFrame([(n, 10**17 + 3, 77) for n in counts], "n long, words long, kept long")
    assert [r[0] for r in df.orderBy("n").select(sa._share(F.col("n"))).collect()] == [1 + 10**9 * (n + 2) // (10**17 + 3 + 154) for n in counts]
