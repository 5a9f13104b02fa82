"""What a page's rules read is made once: its pieces, and the result of an extractor that is tried."""

import re

from pyspark.sql import functions as F

from priceboard.operators import extract_rates as ER
from priceboard.operators import page_tokens as T


def test_a_text_is_cut_once(spark):
    pages = spark.createDataFrame([(1, "<p>22 KT Rs 9000 /gm</p>")], "page_id long, html string")
    p, page = T.read(pages)
    plan = p.select("__numbers")._jdf.queryExecution().analyzed().toString()
    cuts = re.findall(r"(?:split|regexp_extract_all)\(.{0,40}?, " + re.escape(T.NUMBER) + ", ", plan)
    assert len(cuts) == 2, plan


def test_an_extractor_is_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(s):
        calls.add(1)
        return s

    mark = F.udf(seen, "string").asNondeterministic()
    own = lambda page: F.transform(F.split(mark(page.html), "x"), lambda s: F.struct(F.lit("22K").alias("purity"), F.length(s).cast("double").alias("value")))
    pages = spark.range(5).select(F.col("id").alias("page_id"), F.lit("axbb").alias("html"))
    assert [(r["extractor"], r["value"]) for r in ER.found_rates(pages, {"own": own}).filter("page_id = 3").collect()] == [("own", 1.0), ("own", 2.0)]
    assert calls.value == 5


def test_own_extractors_read_what_is_said(spark):
    """The twelve do not read it, so it is made for others only; the first result counts, and pages without one give no row."""
    said = lambda page: F.transform(F.filter(page.numbers, lambda n: n["said"].contains("only")), lambda n: F.struct(F.lit("18K").alias("purity"), n["v"].alias("value")))
    pages = spark.createDataFrame([(1, "<p>now only 7</p>"), (2, "<p>22 KT only Rs 9000 /gm</p>"), (3, "<p>7</p>"), (4, None)], "page_id long, html string")
    got = lambda e: sorted(tuple(r) for r in ER.found_rates(pages, e).collect())
    assert got({"labeled": ER.labeled, "said": said}) == [(1, "said", "18K", 7.0), (2, "labeled", "22K", 9000.0)]
    assert got({"said": said, "labeled": ER.labeled}) == [(1, "said", "18K", 7.0), (2, "said", "18K", 9000.0)]
    assert "said" not in T.read(pages, said=False)[0].select("__numbers").schema.simpleString()
