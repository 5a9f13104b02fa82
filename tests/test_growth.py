"""What keeps the work of a query in step with its input: expressions made once, rows dealt to all tasks, no brand for each scenario where a brand for each kind will do."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from priceboard.functions import scalars as S
from priceboard.functions.tables import spread
from priceboard.operators import extract_making as EM
from priceboard.operators import extract_rates as ER
from priceboard.operators import page_tokens as T


def patterns_in(df):
    """How many regular expressions a row meets, as the plan says them."""
    return len(re.findall(r"regexp_extract|regexp_replace|rlike", df._jdf.queryExecution().analyzed().toString(), re.I))


@pytest.mark.parametrize("name, most", [("labelled_text", 20), ("dom_section", 30), ("direct_percent", 12), ("rsc_breakup", 10)])
def test_strategies_make_a_label_once(spark, name, most):
    pages = spark.createDataFrame([(1, "<p>Making Charges ₹ 500</p>")], "page_id long, html string")
    p, page = T.read(pages, drop_scripts=False)
    assert patterns_in(p.select(EM.STRATEGIES[name].read(page).alias("x"))) - patterns_in(p) <= most


def test_pages_of_one_file_are_many_tasks(spark):
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.lit("<p>22 KT today Rs 9500 / gm</p>").alias("html")).coalesce(1)
    assert spread(pages, "page_id").rdd.getNumPartitions() == 4
    for plan in (EM.readings(pages, {"labelled_text": EM.STRATEGIES["labelled_text"]}), T.read(spread(pages, "page_id"))[0]):
        assert plan.rdd.getNumPartitions() == 4
    assert ER.found_rates(pages).count() == 1000


def test_scenarios_meet_kinds_not_brands(spark):
    """Traps and costs as the rows of each scenario and brand say them; repeated scenarios, missing weights and rates, ties."""
    from priceboard.operators import pricing as P

    k = F.col("id")
    prices = spark.range(60).select(F.concat(F.lit("b"), k.cast("string")).alias("name"), F.element_at(F.array(F.lit("x"), F.lit("y")), (k % 2 + 1).cast("int")).alias("category"), F.lit("22K").alias("karat"), F.when(k != 7, 6000.0 + k % 5).alias("rate"), (k % 11).cast("double").alias("pct"))
    scenarios = spark.range(200).select((k % 190).alias("scenario"), F.when(k % 3 > 0, "x").otherwise("y").alias("category"), F.lit("22K").alias("karat"), F.when(k % 7 > 0, (k % 7).cast("double")).alias("weight"))
    j = scenarios.join(prices, ["category", "karat"]).withColumn("total", S.rounded(P.item_price(F.col("weight"), F.col("rate"), F.col("pct"))))
    w = Window.partitionBy("scenario")
    want = j.select("scenario", "name", "rate", "pct", "total", S.rounded(F.col("total") - F.min("total").over(w)).alias("over_best"), S.rounded(F.col("total") / F.max("total").over(w), 4).alias("bar"))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(P.scenario_costs(scenarios, prices)) == rows(want)
    once = scenarios.filter("scenario >= 10")  # of a scenario of two rows cheapest_trap takes either
    assert rows(P.scenario_traps(once, prices)) == rows(P.cheapest_trap(want.filter("scenario >= 10")))
    assert P._kind_costs(scenarios, prices).count() == 2 * 7 * 30


def test_pages_of_an_archive_are_written_by_all_tasks(spark, tmp_path):
    from priceboard.sources import readers

    pages = spark.range(100).select(F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("-gold-rate-pune-1-jan-2024.html")).alias("name"), F.lit("x").alias("html")).coalesce(1)
    readers.write_page_archive(pages, f"{tmp_path}/a")
    files = list((tmp_path / "a").glob("name=*/part-*"))
    assert len(files) == 100 and len({f.name.split("-")[1] for f in files}) == 4


def test_the_order_of_purities_needs_no_sort(spark):
    from priceboard.operators import board

    rows = [(1, "24K", 100.0), (1, "18K", 101.0), (2, "24K", 100.0), (2, "22K", None), (2, "18K", 101.0), (3, "14K", 9.0), (4, "24K", 100.0), (4, "22K", 92.0), (5, "9K", 1.0)]
    got = board.ordering_sane(spark.createDataFrame(rows, "k int, purity string, value double"), ["k"])
    assert {r["k"]: r["sane"] for r in got.collect()} == {1: False, 2: True, 3: True, 4: True, 5: True}
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()


def test_batches_of_a_stream_are_several_files(spark):
    from priceboard.plans import stream_queries as Q

    files = Q._files(spark, spark.range(1000), "rows", 3, parts=8)
    assert len(files.inputFiles() if not files.isStreaming else list(__import__("pathlib").Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("rows-*/**/part-*.parquet"))) == 24
