"""Distances of the extractors are characters of the visible text: one below, at and above each bound."""

import pytest
from pyspark.sql import functions as F

from priceboard.operators import extract_making as EM
from priceboard.operators import extract_rates as ER
from priceboard.operators import page_tokens as T


def filler(n):
    """n characters without a number, between two spaces."""
    return "" if n == 0 else " " if n == 1 else " " + ("ab-cdé " * n)[: n - 2].replace(" ", "x") + " "


def found(spark, name, texts):
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    p, page = T.read(pages)
    got = p.select("page_id", ER.EXTRACTORS[name](page).alias("r")).collect()
    return {r["page_id"]: [(q["purity"], q["value"]) for q in r["r"]] for r in got}


CASES = {
    "labeled": (35, lambda g: f"<p>22 KT{g}Rs. 9000 /gm</p>", ("22K", 9000.0)),
    "value_karat": (40, lambda g: f"<p>9000.00 INR/gms{g}22k (916)</p>", ("22K", 9000.0)),
    "value_ct": (80, lambda g: f"<p>Rs 9000{g}/Gram (22ct)</p>", ("22K", 9000.0)),
    "value_per_gm": (40, lambda g: f"<p>Rate is Rs.9000 per gm{g}(22kt)</p>", ("22K", 9000.0)),
    "headline": (80, lambda g: f"<p>22Kt Gold Rate{g}1 G ₹9000</p>", ("22K", 9000.0)),
}


@pytest.mark.parametrize("name", CASES)
def test_gaps(spark, name):
    most, page, want = CASES[name]
    gaps = [1, most - 1, most, most + 1, most + 9]
    got = found(spark, name, [page(filler(g)) for g in gaps])
    assert [got[i] == [want] for i in range(len(gaps))] == [g <= most for g in gaps], got


def test_what_is_between(spark):
    got = found(spark, "labeled", ["<p>22 KT, a - b - c - d - e - f - g Rs. 9000 /gm</p>", "<p>22 KT abundantly decorated ornamental traditional handcrafted temple jewellery Rs. 9000 /gm</p>", "<p>22 KT 5 Rs. 9000 /gm</p>"])
    assert got == {0: [("22K", 9000.0)], 1: [], 2: []}
    got = found(spark, "value_per_gm", ["<p>Rs.9000 per gm (of pure) gold 22kt</p>", "<p>Rs.9000 gm (22kt)</p>", "<p>Rs.900 per gm (22kt)</p>"])
    assert got == {0: [], 1: [("22K", 9000.0)], 2: []}
    got = found(spark, "headline", ["<p>22Kt Gold Rate on 24 May 2026: 1 G ₹9000</p>", "<p>22Kt Gold Rate 1 kg ₹9000 1 Gram ₹9100</p>"])
    assert got == {0: [("22K", 9000.0)], 1: [("22K", 9100.0)]}


@pytest.mark.parametrize("side", ["before", "after"])
def test_window_of_proximity(spark, side):
    """The whole of the purity is within 45 characters of the currency or of the amount."""
    gaps = [1, 30, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 60]
    texts = [f"<p>x 22KT{filler(g)}Rs 9000 y</p>" if side == "before" else f"<p>x Rs 9000{filler(g)}22KT y</p>" for g in gaps]
    got = found(spark, "proximity", texts)
    assert [bool(got[i]) for i in range(len(gaps))] == [g + 4 <= 45 for g in gaps]
    two = found(spark, "proximity", [f"<p>18KT{filler(20)}Rs 9000{filler(20)}22KT</p>", f"<p>18KT{filler(60)}Rs 9000{filler(20)}22KT</p>"])
    assert two == {0: [], 1: [("22K", 9000.0)]}


def making(spark, name, texts):
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    p, page = T.read(pages, drop_scripts=False)
    return {r["page_id"]: r["r"] for r in p.select("page_id", EM.STRATEGIES[name].read(page).alias("r")).collect()}


def test_stated_percentage(spark):
    gaps = [1, 19, 20, 21, 30]
    got = making(spark, "direct_percent", [f"<p>Making charges{filler(g)}12%</p>" for g in gaps])
    assert [[x["pct"] for x in got[i]] for i in range(len(gaps))] == [[12.0] if g <= 20 else [] for g in gaps]
    got = making(spark, "direct_percent", ["<p>Making charges on extraordinary hallmarked temple necklaces 12%</p>", "<p>Making Charges GST (3%)</p>", "<p>value addition 9.5 %</p>", "<p>making charges 7 8%</p>"])
    assert [[x["pct"] for x in got[i]] for i in range(4)] == [[], [], [9.5], []]


def test_promotions_sixty_characters_before(spark):
    gaps = [40, 51, 52, 53, 54, 60, 70]
    # 'coupon' has six letters: it is whole in the window while it begins within sixty characters of the label
    got = making(spark, "direct_percent", [f"<p>coupon{filler(g)}Making charges 12%</p>" for g in gaps])
    assert [bool(got[i]) for i in range(len(gaps))] == [g + 6 > 60 for g in gaps]
    got = making(spark, "labelled_text", [f"<p>coupon{(';' * (g - 1)) + ' '}Making charges: Rs 500</p>" for g in gaps])
    assert [bool(got[i]) for i in range(len(gaps))] == [g + 6 > 60 for g in gaps]


def test_offsets(spark):
    text = "é9 ₹ 1,234.50/g 7é 22KT 8"
    df = spark.createDataFrame([(text,)], "t string")
    t = T.tokens(F.col("t"))
    rows = df.select(T.numbers(F.col("t"), t, T.canonical(t)).alias("n")).first()["n"]
    assert [(r["s"], r["start"], r["end"], r["gap"], r["then"]) for r in rows] == [(s, text.index(s), text.index(s) + len(s), g, n) for s, g, n in (("9", "é", " ₹ "), ("1,234.50", " ₹ ", "/g "), ("7", "/g ", "é "), ("22", "é ", "KT "), ("8", "KT ", ""))]
    assert rows[3]["said"] == text[: text.index("22")]
    assert df.select(T.numbers(F.lit(None).cast("string"), T.tokens(F.lit(None).cast("string")), T.canonical(T.tokens(F.lit(None).cast("string")))).alias("n")).first()["n"] == []


def test_unquoted_keys(spark):
    got = found(spark, "product_breakup", ['<script>var p = {metalPrice: 90000, net_weight: 10, option1: "22K"}; </script>22KT', "<script>{'metal_price':'90000','netWeight':'10'}</script>22KT", "<script>{metal_price: 90000, net_weight: 10, stone_value: 5}</script>22KT"])
    assert [got[i] for i in range(3)] == [[("22K", 9000.0)], [("22K", 9000.0)], []]
