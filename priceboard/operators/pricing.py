"""Scenario tables: bills, loans, savings plans, coins, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Coin makers' charges in percent.
MAKERS = {"mmtc": 2.5, "kalyan": 3.0, "malabar": 3.2, "senco": 3.5, "joyalukkas": 3.8, "tanishq": 4.0}


def loan(weight: Column, rate: Column, fraction: Column, ltv: Column, annual: Column, months: Column) -> list[Column]:
    """Value, loan and monthly payment (loan / months at zero interest)."""
    value = weight * rate * fraction
    amount, i = value * ltv, annual / 12 / 100
    g = F.pow(1 + i, months)
    emi = F.when(i == 0, amount / months).otherwise(amount * i * g / (g - 1))
    return [S.rounded(value).alias("gold_value"), S.rounded(amount).alias("loan"), S.rounded(emi).alias("emi")]


def sip(monthly: Column, annual: Column, months: Column, rate: Column) -> list[Column]:
    """Future value of payments at the start of each month, and its grams."""
    i = annual / 12 / 100
    fv = F.when(i == 0, monthly * months).otherwise(monthly * (F.pow(1 + i, months) - 1) / i * (1 + i))
    return [S.rounded(fv).alias("future_value"), S.rounded(fv / rate, 4).alias("grams")]


def making_bill(weight: Column, rate: Column, making: Column, per_gram: Column) -> list[Column]:
    """making: percent of the gold value, or rupees per gram.  Tax on the sum."""
    gold = weight * rate
    mc = F.when(per_gram, making * weight).otherwise(gold * making / 100)
    tax = (gold + mc) * S.GST
    return [S.rounded(gold).alias("gold"), S.rounded(mc).alias("making"), S.rounded(tax).alias("tax"), S.rounded(gold + mc + tax).alias("total")]


def shares(gold: Column, making: Column, tax: Column) -> list[Column]:
    total = gold + making + tax
    return [S.rounded(F.coalesce(F.try_divide(x, total), F.lit(0.0)) * 100, 1).alias(n) for x, n in ((gold, "gold_share"), (making, "making_share"), (tax, "tax_share"))]


def item_price(weight: Column, rate: Column, pct: Column) -> Column:
    gold = weight * rate
    return (gold + gold * pct / 100) * (1 + S.GST)


def budget_grams(budget: Column, rate: Column, pct: Column, making: bool = True, tax: bool = True) -> Column:
    pct = F.greatest(F.lit(0.0), F.least(F.lit(60.0), pct))
    return budget / (rate * ((1 + pct / 100) if making else 1) * ((1 + S.GST) if tax else 1))


def custom_rate(rate: Column, purity: Column) -> Column:
    """A quote of some purity as one of pure gold; an unknown purity counts as pure."""
    return rate / F.coalesce(S.purity_fraction(purity), F.lit(1.0))


def coin_prices(weights: DataFrame, rate: Column) -> DataFrame:
    """weights: grams.  A price per weight and maker."""
    makers = F.explode(F.create_map(*(F.lit(x) for kv in MAKERS.items() for x in kv))).alias("maker", "pct")
    return weights.select("*", makers).select("*", S.rounded(F.col("grams") * rate * (1 + F.col("pct") / 100)).alias("price"))


def stamp(code: Column) -> Column:
    """Purity of a stamp; unknown ones are 22K."""
    c = F.upper(F.coalesce(code, F.lit("")))
    return F.when(c.rlike("24K|999"), "24K").when(c.rlike("18K|750"), "18K").when(c.rlike("14K|585"), "14K").otherwise("22K")


KIND = ["category", "karat", "weight"]


def _kind_costs(scenarios: DataFrame, prices: DataFrame) -> DataFrame:
    """KIND, name, rate, pct, total: the cost of each brand for each kind of scenario.  Scenarios of one category, karat and weight cost the same, so brands meet
    kinds and not scenarios."""
    kinds = scenarios.select(*KIND).distinct()
    return kinds.join(prices.select("name", "category", "karat", "rate", "pct"), ["category", "karat"]).withColumn("total", S.rounded(item_price(F.col("weight"), F.col("rate"), F.col("pct"))))


def _of_kind(scenarios: DataFrame, kinds: DataFrame) -> DataFrame:
    """Scenarios with what is known of their kind; weights that are missing are equal."""
    k = kinds.withColumnsRenamed({c: f"__{c}" for c in KIND})
    same = (F.col("category") == F.col("__category")) & (F.col("karat") == F.col("__karat")) & F.col("weight").eqNullSafe(F.col("__weight"))
    return scenarios.join(k, same).drop(*(f"__{c}" for c in KIND))


def scenario_costs(scenarios: DataFrame, prices: DataFrame) -> DataFrame:
    """scenarios: scenario, category, karat, weight; prices: name, category, karat, rate, pct.  All-in cost of each brand, and what it is over the
    cheapest of the scenario (of all its rows, where it has several).  Only scenarios are shuffled; their rows for each brand come last."""
    costs = _kind_costs(scenarios, prices)
    ends = costs.groupBy(*KIND).agg(F.min("total").alias("__least"), F.max("total").alias("__most"))
    w = Window.partitionBy("scenario")
    s = _of_kind(scenarios.select("scenario", *KIND), ends).withColumns({"__least": F.min("__least").over(w), "__most": F.max("__most").over(w)})
    return _of_kind(s, costs).select("scenario", "name", "rate", "pct", "total", S.rounded(F.col("total") - F.col("__least")).alias("over_best"), S.rounded(F.col("total") / F.col("__most"), 4).alias("bar"))


def scenario_traps(scenarios: DataFrame, prices: DataFrame) -> DataFrame:
    """cheapest_trap(scenario_costs(scenarios, prices)), without a row for each scenario and brand."""
    cheap, least = F.min(F.struct("rate", "name", "total")), F.min(F.struct("total", "name"))
    kinds = _kind_costs(scenarios, prices).groupBy(*KIND).agg(cheap.alias("cheap"), least.alias("least"), F.min("total").alias("total"))
    s = _of_kind(scenarios.select("scenario", *KIND), kinds)
    s = s.groupBy("scenario").agg(F.min("cheap").alias("cheap"), F.min("least").alias("least"), F.min("total").alias("total"))
    return s.select("scenario", F.col("cheap.name").alias("least_rate_brand"), F.col("least.name").alias("least_total_brand"), S.rounded(F.col("cheap.total") - F.col("total")).alias("extra_cost"))


def cheapest_trap(costs: DataFrame) -> DataFrame:
    """Per scenario: brand of the least rate, brand of the least total, and what the first costs more."""
    return costs.groupBy("scenario").agg(
        F.min_by("name", F.struct("rate", "name")).alias("least_rate_brand"), F.min_by("name", F.struct("total", "name")).alias("least_total_brand"),
        S.rounded(F.min_by("total", F.struct("rate", "name")) - F.min("total")).alias("extra_cost"),
    )


def budget_fallback(verified: DataFrame, brands: DataFrame, medians: DataFrame) -> DataFrame:
    """verified: name, category, pct, items.  Brands (name) without any verified category get every category's median as an estimate."""
    rest = brands.join(verified.select("name").distinct(), "name", "left_anti")
    guess = rest.join(medians, F.lit(True), "inner")  # every brand with every category is the result itself; Spark picks the side by size
    guess = guess.select("name", "category", F.col("median_pct").alias("pct"), F.lit(0).cast("long").alias("items"), F.lit("estimate").alias("confidence"))
    return verified.select("name", "category", "pct", "items", "confidence").unionByName(guess)


def budget_board(offers: DataFrame, budget: float) -> DataFrame:
    """offers: name, category, rate, pct.  Grams for a budget and the deficit to the best, per category."""
    g = offers.withColumn("g", budget_grams(F.lit(budget), F.col("rate"), F.col("pct")))
    best = F.max("g").over(Window.partitionBy("category"))
    return g.select("name", "category", S.rounded(F.col("g"), 4).alias("grams"), S.rounded(best - F.col("g"), 4).alias("deficit"))


def full_budget_board(verified: DataFrame, brands: DataFrame, medians: DataFrame, rates: DataFrame, budget: float, own: DataFrame | None = None) -> DataFrame:
    """The budget table as a whole: verified percentages, medians where a brand (name) has none, rates (name, rate), one's own quotes
    (name, category, rate, pct), and what the budget buys."""
    offers = budget_fallback(verified, brands, medians).join(rates, "name").select("name", "category", "rate", "pct")
    return budget_board(offers if own is None else with_own_quote(offers, own), budget)


def with_own_quote(offers: DataFrame, own: DataFrame) -> DataFrame:
    return offers.unionByName(own, allowMissingColumns=True)
