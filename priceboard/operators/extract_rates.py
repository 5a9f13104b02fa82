"""Per-gram rates from saved pages: twelve extractors, tried in order, as columns of one pass over the page.

Each extractor reads a Page (see page_tokens) and gives array<struct<purity, value>>, empty where it finds nothing.  Most are
rules about a number and its neighbours; distances are counted in characters of the visible text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.tables import spread, stored
from . import page_tokens as T
from .board import ordering_sane

#: Characters between a purity and its price: in one line, after a price in one phrase, in one headline.
LINE, PHRASE, HEADLINE = 35, 40, 80
#: Characters on either side of an amount in which the only purity stands.
NEAR = 45
#: What stands at an end of the text between two numbers and does not count: a unit, a unit a gram, a currency, a bracket.
UNIT, PER_UNIT, OF_GRAM = r"^\s*[A-Za-z]+", rf"^\s*{T.CURRENCY}?\s*(?:/|(?i:per)\b)?\s*[A-Za-z]+", r"(?:/|(?i:per)\b)\s*[A-Za-z]+\s*\(\s*$"
MONEY, BRACKET = rf"(?:{T.CURRENCY}\s*)?$", r"\(?\s*$"
PURITIES = [k.rstrip("K") for k in S.FRACTION]


def _none() -> Column:
    return F.array().cast("array<struct<purity:string,value:double>>")


def _valid(arr: Column) -> Column:
    return F.filter(arr, lambda x: x["value"].isNotNull() & S.purity_fraction(x["purity"]).isNotNull())


def _quote(karat: Column, value: Column) -> Column:
    return F.struct(F.concat(karat, F.lit("K")).alias("purity"), S.per_gram(value).alias("value"))


def _one(purity: Column, value: Column) -> Column:
    return _valid(F.array(F.struct(purity.alias("purity"), S.per_gram(value).alias("value"))))


def _rule(page: T.Page, f: Callable) -> Column:
    """f(number, the one before, the one after, the one after that): a quote, or null."""
    n = page.numbers
    return _valid(F.transform(n, lambda x, i: f(x, F.get(n, i - 1), F.get(n, i + 1), F.get(n, i + 2))))


def _is_purity(n: Column) -> Column:
    return n["s"].isin(PURITIES) & n["post"].startswith("K")


def rate_cards(page: T.Page) -> Column:
    """Cards by their classes: the price of ten grams, then its karat."""
    cards = F.split(page.html, 'class="goldCard--rate"')

    def one(card):
        halves = F.split(card, 'class="goldCard--karat"', 2)
        price, karat = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
        of_ten = F.when(price.rlike(r"/\s*10\s*gm"), S.parse_amount(F.regexp_extract(price, r"(?<![#\d])(\d[\d,]*)", 1)))
        return _quote(F.regexp_extract(karat, r"(\d+)\s*(?i:karat)", 1), of_ten / 10)

    return _valid(F.transform(F.slice(cards, 2, 1 << 30), one))


def rows(page: T.Page) -> Column:
    """A purity binds to the prices of its own table row, where that row names one purity."""

    def purities(found, canon):
        named = F.transform(found, lambda t, i: F.when(t.isin(PURITIES) & (F.get(canon, i + 1) == "K"), F.concat(t, F.lit("K"))))
        return F.filter(named, lambda x: x.isNotNull())

    def read(cell):
        """The tokens of a cell, and its purities."""
        return S.once(T.tokens(cell), lambda t: S.once(T.canonical(t), lambda c: F.struct(t.alias("t"), purities(t, c).alias("p"))))

    def prices(cells):
        priced = F.filter(cells, lambda c: F.size(c["p"]) == 0)
        return F.flatten(F.transform(priced, lambda c: F.filter(c["t"], lambda t: t.rlike(r"^\d") & F.length(F.replace(t, F.lit(","), F.lit(""))).between(4, 15))))

    def one(cells):
        def of(named):
            found = F.transform(prices(cells), lambda v: F.struct(F.get(named, F.lit(0)).alias("purity"), S.per_gram(S.parse_amount(v)).alias("value")))
            return F.when((F.size(cells) >= 2) & (F.size(named) == 1), found).otherwise(_none())

        return S.once(F.array_distinct(F.flatten(F.transform(cells, lambda c: c["p"]))), of)

    rows = F.transform(T.table_rows(page.html), lambda cells: F.transform(cells, read))
    return _valid(F.flatten(F.transform(rows, one)))


def product_breakup(page: T.Page) -> Column:
    """Metal price over net weight, of a product without stones.  Keys of a script may be unquoted."""
    loose = lambda read, *keys: F.coalesce(read, S.parse_amount(T.loose_member(page.html, *keys)))
    stone = T.amount(T.member(page, "diamond_price", "diamond_value", "diamondprice", "diamondvalue", "stone_price", "stone_value", "stoneprice", "stonevalue"))
    option = S.once(F.regexp_extract(T.member(page, "option1"), r"^(\d+)\s*K", 1), lambda k: F.nullif(k, F.lit("")))
    named = F.get(F.filter(page.numbers, _is_purity), F.lit(0))["s"]
    stone = loose(stone, "diamond_?price", "diamond_?value", "stone_?price", "stone_?value")
    value = F.try_divide(loose(T.amount(T.member(page, "metal_price", "metalprice")), "metal_?price"), loose(T.amount(T.member(page, "net_weight", "netweight")), "net_?weight"))
    return F.when(F.coalesce(stone, F.lit(0.0)) > 0, _none()).otherwise(_one(F.concat(F.coalesce(option, named), F.lit("K")), value))


def json_breakup(page: T.Page) -> Column:
    """Objects whose title names yellow gold by its fineness, with a rate a gram."""

    def one(m):
        rate = F.try_element_at(m, F.lit("rate"))
        value = F.when(rate.endswith("/g"), T.amount(F.substring_index(rate, "/", 1)))
        purity = S.once(T.tokens(F.try_element_at(m, F.lit("title"))), lambda t: F.when(F.array_join(T.canonical(t), " ") == "# K yellow gold", S.fineness_to_karat(F.get(t, F.lit(0)))))
        return F.struct(purity.alias("purity"), S.per_gram(value).alias("value"))

    return _valid(F.transform(T.objects(page.html), one))


def labeled(page: T.Page) -> Column:
    """A purity, then a price a gram, nothing else that is a number between."""
    return _rule(page, lambda x, p, a, b: F.when(x["post"].startswith("/ G") & p["post"].startswith("K") & (T.length_without(x["gap"], UNIT, MONEY) <= LINE), _quote(p["s"], x["v"])))


def value_karat(page: T.Page) -> Column:
    """A price a gram, then its karat with the fineness in brackets."""
    return _rule(
        page, lambda x, p, a, b: F.when(
            x["post"].rlike("^(₹ )?/ G") & a["post"].startswith("K ( # )") & (T.length_without(x["then"], PER_UNIT) <= PHRASE) & b["s"].isin(list(S.FINENESS)), _quote(a["s"], x["v"])))


def value_ct(page: T.Page) -> Column:
    """A price, later its unit: a gram of so many carats, in brackets."""
    return _rule(page, lambda x, p, a, b: F.when(a["pre"].endswith("/ G (") & (a["unit"] == "ct") & a["post"].startswith("K )") & (T.length_without(x["then"], OF_GRAM) <= HEADLINE), _quote(a["s"], x["v"])))


def value_per_gm(page: T.Page) -> Column:
    """A currency and a price of four digits a gram, then its karat; a bracket may open right before the karat and nowhere else between."""

    def one(x, p, a, b):
        fits = S.once(F.regexp_replace(F.regexp_replace(x["then"], PER_UNIT, ""), BRACKET, ""), lambda between: (F.length(between) <= PHRASE) & ~F.contains(between, F.lit("(")))
        return F.when(T.marked(x) & (x["digits"] >= 4) & x["post"].rlike("^(/ )?G") & (a["unit"] == "kt") & fits, _quote(a["s"], x["v"]))

    return _rule(page, one)


def pregst(page: T.Page) -> Column:
    """A price before a tax of three percent, on a page about 24 karat."""
    pure = F.exists(page.numbers, lambda n: (n["s"] == "24") & (n["unit"].startswith("k")) | (n["s"] == "99.9"))
    found = _rule(page, lambda x, p, a, b: F.when(T.marked(x) & x["post"].startswith("+ # % gst") & (a["s"] == "3"), _quote(F.lit("24"), x["v"])))
    return F.when(pure, F.slice(found, 1, 1)).otherwise(_none())


def gold_value(page: T.Page) -> Column:
    """The value of an item's gold over its weight; weight and karat on the line go before those of the page."""
    n = page.numbers
    title, opened = r"(?:^| )gold(?: value| rate| amount)?", r"(?: [:(]){0,4}"
    first = lambda cond: F.get(F.filter(n, cond), F.lit(0))
    weight = first(lambda x: x["pre"].rlike(r"(?:^| )weight(?: [^# ]+){0,3}$") & x["post"].startswith("G"))["v"]
    typed = first(lambda x: x["pre"].rlike(r"(?:^| )(?:purity|type)(?: [^# ]+){0,4}$") & x["post"].startswith("K"))["s"]
    named = first(lambda x: (x["digits"] == 2) & x["post"].startswith("K"))["s"]

    def one(x, i):
        p, pp = F.get(n, i - 1), F.get(n, i - 2)
        plain = x["pre"].rlike(title + opened + r" ₹(?: \.)?$")
        weighed = p["pre"].rlike(title + opened + "$") & p["post"].rlike(r"^G(?: \.)?(?: \))? ₹") & (x["at"] - p["at"] <= 6)
        of_line = F.when(weighed, F.when(pp["post"].startswith("K gold"), pp["s"])).otherwise(F.when(p["post"].startswith("K gold"), p["s"]))
        value = F.try_divide(x["v"], F.when(weighed, p["v"]).otherwise(weight))
        return F.when(T.marked(x) & (plain | weighed), _quote(F.coalesce(of_line, typed, named), value))

    return _valid(F.slice(F.filter(F.transform(n, one), lambda q: q.isNotNull()), 1, 1))


def headline(page: T.Page) -> Column:
    """A purity's gold rate, then that of one gram; other numbers may stand between."""
    n = page.numbers

    def one(x):
        said = x["end"] + F.length(F.regexp_extract(x["then"], r"(?i)^\s*[a-z]+\s+gold\s+rate", 0))

        def of_one(a, j):
            b = F.get(n, j + 1)
            return F.when((a["start"] >= said) & (a["start"] - said <= HEADLINE) & (a["s"] == "1") & a["post"].startswith("G") & (b["at"] - a["at"] <= 3) & b["digits"].between(3, 7), b["v"])

        price = F.get(F.filter(F.transform(n, of_one), lambda v: v.isNotNull()), F.lit(0))
        return F.when(x["post"].startswith("K gold rate"), _quote(x["s"], price))

    return F.slice(_valid(F.transform(n, one)), 1, 1)


def proximity(page: T.Page) -> Column:
    """Amounts with one purity, number and K, within NEAR characters before the currency or after the amount."""
    n = page.numbers

    def one(x, i):
        start = F.greatest(i - NEAR // 2, F.lit(0))
        around = F.filter(F.slice(n, start + 1, NEAR), _is_purity)
        begins = x["start"] - F.length(F.regexp_extract(x["gap"], rf"{T.CURRENCY}\s*$", 0)) - NEAR
        unit = lambda y: F.length(F.regexp_extract(y["then"], r"^\s*[A-Za-z]+", 0))
        near = lambda first: F.filter(around, lambda y: (y["start"] >= first) & (y["end"] + unit(y) <= x["end"] + NEAR))
        distinct = S.once(begins, lambda first: F.array_distinct(F.transform(near(first), lambda y: y["s"])))
        only = S.once(distinct, lambda named: F.when(F.size(named) == 1, _quote(F.get(named, F.lit(0)), x["v"])))
        return F.when(T.marked(x) & x["digits"].between(4, 12), only)

    return _valid(F.transform(n, one))


#: In the order tried; a user's own function(page) may be put anywhere.
EXTRACTORS = {f.__name__: f for f in (rate_cards, rows, product_breakup, json_breakup, labeled, value_karat, value_ct, value_per_gm, pregst, gold_value, headline, proximity)}


def found_rates(pages: DataFrame, extractors: dict | None = None) -> DataFrame:
    """page_id, extractor, purity, value: what the first extractor with a result finds on each page."""
    chosen = extractors or EXTRACTORS
    p, page = T.read(spread(pages, "page_id"), said=any(f not in EXTRACTORS.values() for f in chosen.values()))  # none of the twelve reads it
    tried = lambda name, f: S.once(f(page), lambda arr: F.when(F.size(arr) > 0, F.struct(F.lit(name).alias("extractor"), arr.alias("found"))))
    pick = F.coalesce(*(tried(name, f) for name, f in chosen.items()))  # the first that is not null; those after it are not made
    # stored before anything filters it: a filter moved below would make the tokens anew wherever a rule reads them
    read = stored(p.select("page_id", pick.alias("r")), "read")
    return read.filter("r is not null").select("page_id", "r.extractor", F.inline("r.found"))


def extract_rates(pages: DataFrame, extractors: dict | None = None) -> DataFrame:
    """Exact median and count per page and purity."""
    return found_rates(pages, extractors).groupBy("page_id", "extractor", "purity").agg(F.median("value").alias("value"), F.count("*").alias("n"))


def accept_rates(pages: DataFrame, rates: DataFrame) -> DataFrame:
    """page_id, verdict: 'no values', 'MISLABELLED' (a lower purity costs more) or 'ok'."""
    j = pages.select("page_id").join(ordering_sane(rates, ["page_id"]), "page_id", "left")
    return j.select("page_id", F.when(F.col("sane").isNull(), "no values").when(F.col("sane"), "ok").otherwise("MISLABELLED").alias("verdict"))


def prefer_structured(found: DataFrame) -> DataFrame:
    """found: page_id, snapshot (order), extractor...: rows of the best snapshot: structured before proximity, then in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy(F.col("extractor") == "proximity", "snapshot")
    return found.withColumn("__r", F.dense_rank().over(w)).filter("__r = 1").drop("__r")
