"""The registered queries: operator compositions over the test tables, each with SQL that says the same another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.tables import shared_dir, stored
from ..operators import board, click_debounce as click_debounce_, pages, pricing, robust, sampling, search, subscribers, traffic
from ..sources import readers, sinks
from . import bindings as B
from .bindings import D, FRAC, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _day(text: str):
    return F.lit(text).cast("date")


KARATS = ("24K", "22K", "18K", "14K")
LADDER = lambda c, karats=KARATS: ", ".join(f"{D(f'{c} * {FRAC(repr(k))}')} AS rate_{k.lower()}" for k in karats)

# ---- rates and boards


@query(f"""WITH {B.LIVE}, {B.STATS}, b AS (SELECT live.*, stats.*, {D('canonical - m')} AS delta FROM live, stats)
SELECT (row_number() OVER (ORDER BY canonical, name))::INT AS rank, name, canonical, {LADDER('canonical', KARATS[1:])}, delta,
 CASE WHEN delta >= 0.5 THEN 'high' WHEN delta <= -0.5 THEN 'low' ELSE 'par' END AS level, canonical = lowest AND name = lowest_brand AS is_lowest, NOT national AS regional, CASE WHEN NOT national THEN states[1] END AS states FROM b""")
def market_board(spark, sf):
    return board.market_board(B.live_rows(spark, sf))


@query(f"WITH {B.RATES} SELECT * FROM rates")
def canonical_rates(spark, sf):
    return B.rates(spark, sf)


@query(f"WITH {B.RATES} SELECT brand_id, rate_date, k AS purity, {D('canonical * ' + FRAC('k'))} AS rate FROM rates, (VALUES ('24K'), ('22K'), ('18K'), ('14K')) v(k)")
def purity_ladder_long(spark, sf):
    return board.ladder_long(B.rates(spark, sf), ["brand_id", "rate_date"])


def _per_purity(spark, sf):
    return B.quotes(spark, sf).groupBy("brand_id", "rate_date", "purity").agg(F.max("value").alias("value"))


PER = f"{B.QUOTES}, per AS (SELECT brand_id, rate_date, purity, max(value) AS value, {FRAC('purity')} AS f FROM quotes GROUP BY ALL)"


@query(f"""WITH {PER} SELECT a.brand_id, a.rate_date, bool_and(b.value IS NULL OR b.value <= a.value * CAST(1.005 AS DOUBLE)) AS sane FROM per a
LEFT JOIN per b ON a.brand_id = b.brand_id AND a.rate_date = b.rate_date AND b.f = (SELECT max(c.f) FROM per c WHERE c.brand_id = a.brand_id AND c.rate_date = a.rate_date AND c.f < a.f) GROUP BY ALL""")
def ordering_check(spark, sf):
    return board.ordering_sane(_per_purity(spark, sf), ["brand_id", "rate_date"])


@query(f"""WITH {PER}, x AS (SELECT a.brand_id, a.rate_date, count(DISTINCT a.purity)::INT AS purities, coalesce(bool_or(b.f <> a.f AND abs((a.value / b.value) / (a.f / b.f) - 1) > CAST(0.015 AS DOUBLE)), false) AS bad
FROM per a JOIN per b ON a.brand_id = b.brand_id AND a.rate_date = b.rate_date GROUP BY ALL)
SELECT brand_id, rate_date, purities, purities > 1 AND NOT bad AS confirmed, CASE WHEN purities < 2 THEN 'single purity' WHEN bad THEN 'ratio off' ELSE 'ok' END AS note FROM x""")
def basis_check(spark, sf):
    return board.basis_confirmed(_per_purity(spark, sf), ["brand_id", "rate_date"])


@query(f"WITH {B.LIVE} SELECT brand_id, rate_date, name, canonical FROM live WHERE rate_date >= DATE '{B.AS_OF}' - 10")
def latest_carry_forward(spark, sf):
    r = board.latest_published(B.rates(spark, sf), _day(B.AS_OF), 10)
    return board.with_brands(r, B.brands(spark, sf)).select("brand_id", "rate_date", "name", "canonical")


@query(f"WITH {B.TREND} SELECT * FROM trend")
def daily_trend(spark, sf):
    return board.daily_trend(B.rates(spark, sf), _day(B.AS_OF))


MOVES = f"{B.TREND}, mv AS (SELECT *, lag(median_24k) OVER (ORDER BY rate_date) AS prev FROM trend), moves AS (SELECT rate_date, median_24k, prev, {D('median_24k - prev')} AS move, {D('coalesce((median_24k - prev) / nullif(prev, 0) * 100, 0)', 4)} AS pct FROM mv)"


@query(f"WITH {MOVES} SELECT * FROM moves")
def session_moves(spark, sf):
    return board.session_moves(daily_trend(spark, sf))


@query(f"""WITH {MOVES} SELECT rate_date, 'gold-rate-recap-' || lower(strftime(rate_date, '%-d-%b-%Y')) AS slug, strftime(rate_date, '%d %B %Y') AS shown, {D('median_24k')} AS median_24k, move, pct,
CASE WHEN move > 0.5 THEN 'rose' WHEN move < -0.5 THEN 'fell' ELSE 'held' END AS verb, rate_date >= DATE '{B.AS_OF}' - 90 AS fresh FROM moves WHERE prev IS NOT NULL""")
def market_recaps(spark, sf):
    return board.recaps(daily_trend(spark, sf), _day(B.AS_OF))


@query(f"WITH {MOVES} SELECT rate_date, median_24k FROM moves ORDER BY rate_date DESC LIMIT 10")
def newest_trend_days(spark, sf):
    return board.newest(daily_trend(spark, sf), "rate_date", 10)


@query(f"WITH {B.LIVE}, {B.STATS} SELECT {LADDER('m')}, lowest, lowest_brand, highest, highest_brand, {D('highest - lowest', 0)} AS spread, n, {D('m', 6)} AS median_24k FROM stats")
def market_snapshot(spark, sf):
    return board.market_snapshot(B.live_rows(spark, sf))


@query(f"""WITH {B.LIVE}, {B.STATS}, p2 AS (SELECT * FROM pub WHERE rate_date <= DATE '{B.AS_OF}'), t AS (SELECT rate_date, median(canonical) AS md FROM p2 GROUP BY 1),
lm AS (SELECT {D('md - lag(md) OVER (ORDER BY rate_date)')} AS move, rate_date FROM t), l1 AS (SELECT move FROM lm ORDER BY rate_date DESC LIMIT 1)
SELECT n_name AS place, 'gold-rate-' || lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '-', 'g')) || '-' || lower(strftime(DATE '{B.AS_OF}', '%-d-%b-%Y')) AS slug, {LADDER('m')}, lowest, n, move,
CASE WHEN move > 0.5 THEN 'rose' WHEN move < -0.5 THEN 'fell' ELSE 'held' END AS verb FROM nation, stats, l1""")
def place_rows(spark, sf):
    moves = board.session_moves(board.publishable(B.rates(spark, sf)).filter(F.col("rate_date") <= _day(B.AS_OF)).groupBy("rate_date").agg(F.median("canonical").alias("median_24k")))
    last = board.newest(moves, "rate_date", 1).select("move")
    return board.daily_place_rows(market_snapshot(spark, sf), table(spark, sf, "nation").select(F.col("n_name").alias("place")), last, _day(B.AS_OF))


@query("WITH " + B.BRANDS + " SELECT name, state, national FROM brands WHERE national OR list_contains(states, 'INDIA')")
def area_board(spark, sf):
    return board.serves_area(B.brands(spark, sf), "INDIA").select("name", "state", "national")


@query("WITH " + B.BRANDS + " SELECT name FROM brands WHERE contains(lower(name), '00000001')")
def brand_search(spark, sf):
    return board.brand_search(B.brands(spark, sf), " 00000001 ").select("name")


@query(f"""WITH {PER},
r1 AS (SELECT *, row_number() OVER (PARTITION BY brand_id, rate_date ORDER BY {FRAC('purity')} DESC, seq DESC) AS rn FROM quotes),
c AS (SELECT brand_id, rate_date, {B.CANON} AS canonical FROM r1 WHERE rn = 1),
x AS (SELECT a.brand_id, a.rate_date, count(DISTINCT a.purity) > 1 AND NOT coalesce(bool_or(b.f <> a.f AND abs((a.value / b.value) / (a.f / b.f) - 1) > CAST(0.015 AS DOUBLE)), false) AS confirmed
 FROM per a JOIN per b ON a.brand_id = b.brand_id AND a.rate_date = b.rate_date GROUP BY ALL),
m AS (SELECT rate_date, median(canonical) AS m, count(*) AS live FROM c GROUP BY 1)
SELECT c.brand_id, c.rate_date, canonical, confirmed, CASE WHEN live >= 5 THEN {D('abs(canonical - m) / m', 4)} END AS drift_from_median,
CASE WHEN live >= 5 AND abs(canonical - m) / m > CAST(0.04 AS DOUBLE) AND NOT confirmed THEN 'quarantined' ELSE 'published' END AS status FROM c JOIN x USING (brand_id, rate_date) JOIN m USING (rate_date)""")
def outlier_quarantine(spark, sf):
    keys = ["brand_id", "rate_date"]
    r = B.rates(spark, sf).select(*keys, "canonical").join(basis_check(spark, sf).select(*keys, "confirmed"), keys)
    out = board.outlier_quarantine(r, by=["rate_date"])
    return out.select(*keys, "canonical", "confirmed", "drift_from_median", "status")


@query(f"""WITH {B.LIVE} SELECT brand_id, DATE '{B.AS_OF}' AS rate_date, {D('(SELECT median(canonical) FROM live)')} AS canonical, 'estimated' AS status, 'reference-median' AS method
FROM brands WHERE brand_id NOT IN (SELECT brand_id FROM live) AND EXISTS (SELECT 1 FROM live)""")
def placeholder_fill(spark, sf):
    return board.placeholder_fill(B.brands(spark, sf), B.live_rows(spark, sf), _day(B.AS_OF))


@query(f"""WITH {B.QUOTES}, v AS (SELECT brand_id, rate_date, CASE WHEN l_tax < 0.01 THEN NULL ELSE {B.CANON} END AS canonical, seq FROM quotes)
SELECT brand_id, rate_date, canonical, seq FROM (SELECT *, row_number() OVER (PARTITION BY brand_id, rate_date ORDER BY seq DESC) AS rn FROM v WHERE canonical IS NOT NULL) WHERE rn = 1""")
def rates_merge(spark, sf):
    q = B.quotes(spark, sf)
    v = q.select("brand_id", "rate_date", F.when(F.col("l_tax") >= 0.01, board.canonical_24k(F.col("purity"), F.col("value"), F.col("includes_gst"))).alias("canonical"), "seq")
    old, new = v.filter("seq % 20 < 10 and canonical is not null"), v.filter("seq % 20 >= 10")
    return sinks.merge_rates(old, new, seq="seq")


@query(f"""WITH {B.LIVE}, {B.STATS}, p AS (SELECT name, canonical, canonical - CAST(1500 AS DOUBLE) AS pr FROM live)
SELECT name, canonical, {D('pr')} AS premium, {D('pr / 1500 * 100')} AS premium_pct, {D('least(1.0, greatest(0.0, abs(pr) / (SELECT max(abs(pr)) FROM p)))', 4)} AS bar FROM p""")
def premium_board(spark, sf):
    return board.premium_board(B.live_rows(spark, sf), spark.range(1).select(F.lit(1500.0).alias("bullion")))


@query(f"WITH {B.LIVE}, {B.STATS} SELECT count(*) AS live, (SELECT count(*) FROM brands) - count(*) AS estimated, (SELECT count(*) FROM brands) AS total FROM live")
def coverage(spark, sf):
    live = B.live_rows(spark, sf).select("brand_id", F.lit(True).alias("on"))
    return B.brands(spark, sf).join(live, "brand_id", "left").agg(F.count_if("on").alias("live"), F.count_if(F.col("on").isNull()).alias("estimated"), F.count("*").alias("total"))


# ---- robust statistics
MAD = f"""{B.OFFERS}, md AS (SELECT brand, category, median(pct) AS m, count(*) AS n FROM offers GROUP BY ALL), dv AS (SELECT offers.*, m, n, abs(pct - m) AS d FROM offers JOIN md USING (brand, category)),
ma AS (SELECT brand, category, median(d) AS mad FROM dv GROUP BY ALL), sc AS (SELECT dv.*, CASE WHEN n < 4 OR mad = 0 THEN true ELSE abs(CAST(0.6745 AS DOUBLE) * (pct - m) / mad) <= CAST(1.5 AS DOUBLE) END AS kept FROM dv JOIN ma USING (brand, category))"""
SUM = f"""{MAD}, su AS (SELECT brand, category, count(*) FILTER (kept) AS items, {D('median(pct) FILTER (kept)', 1)} AS median_pct, {D('min(pct) FILTER (kept)', 1)} AS min_pct, {D('max(pct) FILTER (kept)', 1)} AS max_pct, count(*) FILTER (NOT kept) AS rejected,
CASE WHEN count(*) FILTER (kept) >= 12 THEN 'high' WHEN count(*) FILTER (kept) >= 5 THEN 'medium' WHEN count(*) FILTER (kept) > 0 THEN 'low' ELSE 'none' END AS confidence FROM sc GROUP BY brand, category)"""


@query(f"WITH {MAD} SELECT id, brand, category, pct, kept FROM sc")
def mad_outliers(spark, sf):
    return robust.mad_scores(B.offers(spark, sf), ["brand", "category"], "pct", 1.5).select("id", "brand", "category", "pct", "kept")


@query(f"WITH {SUM} SELECT * FROM su")
def category_summary(spark, sf):
    return robust.summarize(B.offers(spark, sf), ["brand", "category"], "pct", 1.5)


@query(f"""WITH {B.OFFERS}, o AS (SELECT brand, list_sort(list(pct)) AS v, count(*) AS n FROM offers GROUP BY 1 HAVING count(*) >= 4)
SELECT brand, {', '.join(D(f"v[({k} * (n + 1)) // 4] * (1 - ({k} * (n + 1) % 4) / CAST(4 AS DOUBLE)) + coalesce(v[({k} * (n + 1)) // 4 + 1], 0) * (({k} * (n + 1) % 4) / CAST(4 AS DOUBLE))", 4) + f" AS q{k}" for k in (1, 2, 3))} FROM o""")
def brand_quartiles(spark, sf):
    return robust.quartiles(B.offers(spark, sf), ["brand"], "pct")


@query(f"WITH {SUM} SELECT category, {D('median(median_pct)', 1)} AS median_pct FROM su GROUP BY 1")
def category_medians(spark, sf):
    return robust.category_medians(category_summary(spark, sf))


@query(f"""WITH {B.RATES}, s AS (SELECT brand_id AS brand, year(rate_date) AS y, {D('median(canonical)', 1)} AS median_pct FROM rates GROUP BY ALL), a AS (SELECT * FROM s WHERE y = 2000), b AS (SELECT * FROM s WHERE y = 1999)
SELECT a.brand, a.median_pct, b.median_pct AS prev, {D('a.median_pct - b.median_pct', 1)} AS delta, coalesce(abs(a.median_pct - b.median_pct) > greatest(5, b.median_pct * CAST(0.35 AS DOUBLE)), false) AS flagged FROM a LEFT JOIN b USING (brand)""")
def summary_drift(spark, sf):
    s = B.rates(spark, sf).groupBy(F.col("brand_id").alias("brand"), F.year("rate_date").alias("y")).agg(S.rounded(F.median("canonical"), 1).alias("median_pct"))
    return robust.drift(s.filter("y = 2000"), s.filter("y = 1999"), ["brand"])


# ---- pricing
@query(f"""WITH {SUM}, v AS (SELECT brand AS name, category, median_pct AS pct, items, confidence FROM su WHERE brand < 'Brand#4'), nm AS (SELECT DISTINCT p_brand AS name FROM part), cm AS (SELECT category, {D('median(median_pct)', 1)} AS median_pct FROM su GROUP BY 1)
SELECT * FROM v UNION ALL SELECT name, category, median_pct, 0, 'estimate' FROM nm, cm WHERE name NOT IN (SELECT name FROM v)""")
def budget_fallback(spark, sf):
    su = category_summary(spark, sf)
    v = su.filter("brand < 'Brand#4'").select(F.col("brand").alias("name"), "category", F.col("median_pct").alias("pct"), "items", "confidence")
    names = table(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct()
    return pricing.budget_fallback(v, names, robust.category_medians(su))


PRICES = f"""{SUM}, br AS (SELECT DISTINCT p_brand AS brand FROM part), rt AS (SELECT brand, 6000 + CAST(right(brand, 1) AS INT) * CAST(12.5 AS DOUBLE) AS rate FROM br), pr AS (SELECT brand AS name, category, rate, median_pct AS pct FROM su JOIN rt USING (brand)),
sn AS (SELECT o_orderkey AS scenario, (SELECT list(DISTINCT category ORDER BY category) FROM su)[o_orderkey % 6 + 1] AS category, CAST(1 + o_orderkey % 20 AS DOUBLE) AS weight FROM orders),
cost AS (SELECT scenario, name, rate, pct, {D('(weight * rate + weight * rate * pct / 100) * CAST(1.03 AS DOUBLE)')} AS total FROM sn JOIN pr USING (category)),
ic AS (SELECT *, {D('total - min(total) OVER (PARTITION BY scenario)')} AS over_best, {D('total / max(total) OVER (PARTITION BY scenario)', 4)} AS bar FROM cost)"""


def _prices(spark, sf):
    rate = 6000 + F.right("brand", F.lit(1)).cast("int") * 12.5
    return category_summary(spark, sf).select(F.col("brand").alias("name"), "category", F.lit("24K").alias("karat"), rate.alias("rate"), F.col("median_pct").alias("pct"))


@query(f"WITH {PRICES} SELECT * FROM ic")
def item_cost_board(spark, sf):
    return pricing.scenario_costs(*_scenarios(spark, sf))


def _scenarios(spark, sf):
    """An item of each order, and the prices."""
    p = stored(_prices(spark, sf), "prices")
    kinds, k = p.agg(F.array_sort(F.collect_set("category")).alias("kinds")), F.col("o_orderkey")  # one row of a few categories
    s = table(spark, sf, "orders").crossJoin(F.broadcast(kinds))
    return s.select(k.alias("scenario"), F.get("kinds", (k % 6).cast("int")).alias("category"), F.lit("24K").alias("karat"), (1 + k % 20).cast("double").alias("weight")), p


@query(f"""WITH {PRICES} SELECT scenario, min_by(name, (rate, name)) AS least_rate_brand, min_by(name, (total, name)) AS least_total_brand, {D('min_by(total, (rate, name)) - min(total)')} AS extra_cost FROM ic GROUP BY scenario""")
def cheapest_trap(spark, sf):
    return pricing.scenario_traps(*_scenarios(spark, sf))


@query(f"""WITH {PRICES}, g AS (SELECT name, category, 100000 / (rate * (1 + greatest(0.0, least(60.0, pct)) / 100) * CAST(1.03 AS DOUBLE)) AS g FROM pr)
SELECT name, category, {D('g', 4)} AS grams, {D('max(g) OVER (PARTITION BY category) - g', 4)} AS deficit FROM g""")
def budget_grams(spark, sf):
    return pricing.budget_board(_prices(spark, sf), 100_000.0)


@query(f"""WITH x AS (SELECT o_orderkey, CAST(1 + o_orderkey % 50 AS DOUBLE) AS w, CAST(12 * (1 + o_orderkey % 3) AS DOUBLE) AS n, CAST(o_orderkey % 4 * 6 AS DOUBLE) AS r FROM orders), y AS (SELECT *, w * 6000 * CAST(22 AS DOUBLE) / 24 AS v0, r / 12 / 100 AS i FROM x),
z AS (SELECT *, w * 6000 * {FRAC("'22K'")} AS v FROM y) SELECT o_orderkey, {D('v')} AS gold_value, {D('v * CAST(0.75 AS DOUBLE)')} AS loan, {D('CASE WHEN i = 0 THEN v * CAST(0.75 AS DOUBLE) / n ELSE v * CAST(0.75 AS DOUBLE) * i * pow(1 + i, n) / (pow(1 + i, n) - 1) END')} AS emi FROM z""")
def loan_emi(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    d = lambda c: c.cast("double")
    return o.select("o_orderkey", *pricing.loan(d(1 + k % 50), F.lit(6000.0), F.lit(S.FRACTION["22K"]), F.lit(0.75), d(k % 4 * 6), d(12 * (1 + k % 3))))


@query(f"""WITH x AS (SELECT o_orderkey, CAST(500 + o_orderkey % 10 * 100 AS DOUBLE) AS p, CAST(12 * (1 + o_orderkey % 5) AS DOUBLE) AS n, CAST(o_orderkey % 3 * 4 AS DOUBLE) / 12 / 100 AS i FROM orders), y AS (SELECT *, CASE WHEN i = 0 THEN p * n ELSE p * (pow(1 + i, n) - 1) / i * (1 + i) END AS fv FROM x)
SELECT o_orderkey, {D('fv')} AS future_value, {D('fv / 6000', 4)} AS grams FROM y""")
def sip_value(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    d = lambda c: c.cast("double")
    return o.select("o_orderkey", *pricing.sip(d(500 + k % 10 * 100), d(k % 3 * 4), d(12 * (1 + k % 5)), F.lit(6000.0)))


BILL = "b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * 6000 AS g, CASE WHEN p_partkey % 2 = 0 THEN CAST(300 + p_partkey % 50 AS DOUBLE) * p_size ELSE CAST(p_size AS DOUBLE) * 6000 * CAST(5 + p_partkey % 20 AS DOUBLE) / 100 END AS m FROM part), t AS (SELECT *, (g + m) * CAST(0.03 AS DOUBLE) AS x FROM b)"


@query(f"WITH {BILL} SELECT p_partkey, {D('g')} AS gold, {D('m')} AS making, {D('x')} AS tax, {D('g + m + x')} AS total FROM t")
def making_bill(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    per = k % 2 == 0
    return p.select("p_partkey", *pricing.making_bill(F.col("p_size").cast("double"), F.lit(6000.0), F.when(per, 300 + k % 50).otherwise(5 + k % 20).cast("double"), per))


@query(f"WITH {BILL} SELECT p_partkey, " + ", ".join(D(f"coalesce({c} / nullif(g + m + x, 0), 0) * 100", 1) + f" AS {n}_share" for c, n in (("g", "gold"), ("m", "making"), ("x", "tax"))) + " FROM t")
def bill_shares(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    g = F.col("p_size").cast("double") * 6000
    m = F.when(k % 2 == 0, (300 + k % 50).cast("double") * F.col("p_size")).otherwise(g * (5 + k % 20).cast("double") / 100)
    return p.select("p_partkey", *pricing.shares(g, m, (g + m) * S.GST))


@query("WITH m(maker, pct) AS (VALUES ('mmtc', CAST(2.5 AS DOUBLE)), ('kalyan', 3.0), ('malabar', 3.2), ('senco', 3.5), ('joyalukkas', 3.8), ('tanishq', 4.0)" f"), w AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS grams FROM part) SELECT grams, maker, pct, {D('grams * 6000 * (1 + pct / 100)')} AS price FROM w, m")
def coin_prices(spark, sf):
    return pricing.coin_prices(table(spark, sf, "part").select(F.col("p_size").cast("double").alias("grams")).distinct(), F.lit(6000.0))


@query(f"""WITH s AS (SELECT p_partkey, p_size, ['916', '750 18K', 'x585', '999', ''][p_partkey % 5 + 1] AS code FROM part), t AS (SELECT *, CASE WHEN code LIKE '%999%' THEN '24K' WHEN code LIKE '%750%' THEN '18K' WHEN code LIKE '%585%' THEN '14K' ELSE '22K' END AS purity FROM s)
SELECT p_partkey, purity, {D('p_size * 6000 * ' + FRAC('purity'))} AS value FROM t""")
def stamp_value(spark, sf):
    code = F.element_at(F.array(*map(F.lit, ["916", "750 18K", "x585", "999", ""])), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = table(spark, sf, "part").select("p_partkey", "p_size", pricing.stamp(code).alias("purity"))
    return p.select("p_partkey", "purity", S.rounded(F.col("p_size") * 6000 * S.purity_fraction(F.col("purity"))).alias("value"))


# ---- traffic
V, VC = f"WITH {B.VIEWS}", f"WITH {B.VIEWS}, {B.CLICKS}"
RANGE = ("2024-01-05", "2024-01-20")
IN = f"day BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'"


@query(f"{V} SELECT day, count(*) AS views, count(DISTINCT session_id) AS visitors FROM views GROUP BY 1")
def daily_hits(spark, sf):
    return traffic.daily_hits(B.views(spark, sf))


@query(f"{V} SELECT day, page, count(*) AS views FROM views GROUP BY ALL")
def daily_top_pages(spark, sf):
    return traffic.daily_top(B.views(spark, sf), "page", "views")


@query(f"{VC} SELECT day, target, count(*) AS clicks FROM clicks GROUP BY ALL")
def daily_top_clicks(spark, sf):
    return traffic.daily_top(B.clicks(spark, sf), "target", "clicks")


def _report(spark, sf, page=None):
    return traffic.report(B.views(spark, sf), B.clicks(spark, sf), *RANGE, page)


@query(f"{VC} SELECT (SELECT count(*) FROM views WHERE {IN} AND page = '/p/3') AS views, (SELECT count(DISTINCT session_id) FROM views WHERE {IN} AND page = '/p/3') AS visitors, (SELECT count(*) FROM clicks WHERE {IN} AND page = '/p/3') AS clicks")
def traffic_report_totals(spark, sf):
    return _report(spark, sf, "/p/3")["totals"]


@query(f"{V} SELECT day, count(*) AS views, count(DISTINCT session_id) AS visitors FROM views WHERE {IN} GROUP BY 1")
def traffic_report_daily(spark, sf):
    return _report(spark, sf)["daily"]


@query(f"{V} SELECT page, count(*) AS views FROM views WHERE {IN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def traffic_report_pages(spark, sf):
    return _report(spark, sf)["pages"]


@query(f"{VC} SELECT target, count(*) AS clicks FROM clicks WHERE {IN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def traffic_report_clicks(spark, sf):
    return _report(spark, sf)["clicks"]


@query(f"{V} SELECT coalesce(nullif(referrer, ''), '(direct)') AS referrer, count(*) AS views FROM views WHERE {IN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def traffic_report_referrers(spark, sf):
    return _report(spark, sf)["referrers"]


@query(f"{V} SELECT coalesce(nullif(host, ''), '(unknown)') AS host, count(*) AS views FROM views WHERE {IN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def traffic_report_hosts(spark, sf):
    return _report(spark, sf)["hosts"]


@query(f"{V} SELECT DISTINCT page FROM views WHERE {IN}")
def traffic_report_pagelist(spark, sf):
    return _report(spark, sf, "/p/3")["page_list"]


@query(f"""WITH RECURSIVE {B.EV}, {B.CLICKS}, o AS (SELECT session_id, id, label, ms, row_number() OVER (PARTITION BY session_id ORDER BY ms, id) AS rn FROM clicks),
w AS (SELECT session_id, id, label, ms, rn, true AS kept, label AS l, ms AS m FROM o WHERE rn = 1 UNION ALL
SELECT o.session_id, o.id, o.label, o.ms, o.rn, NOT (o.label = w.l AND o.ms - w.m < 86400000) AS kept, CASE WHEN o.label = w.l AND o.ms - w.m < 86400000 THEN w.l ELSE o.label END, CASE WHEN o.label = w.l AND o.ms - w.m < 86400000 THEN w.m ELSE o.ms END
FROM w JOIN o ON o.session_id = w.session_id AND o.rn = w.rn + 1) SELECT session_id, id FROM w WHERE kept""")
def click_debounce(spark, sf):
    return click_debounce_.debounce(B.clicks(spark, sf), 86_400_000)


@query(f"{V} SELECT count(DISTINCT session_id) AS visits FROM views")
def total_visits(spark, sf):
    return traffic.total_visits(B.views(spark, sf))


@query(f"""{VC} SELECT id, CASE id % 7 WHEN 0 THEN '(unlabelled)' WHEN 1 THEN 'Use my location (autofill)' WHEN 2 THEN '22K rate column' WHEN 3 THEN 'Near me' WHEN 4 THEN '(unlabelled)' WHEN 5 THEN '₹' ELSE CASE WHEN target = 't1' THEN 'One' ELSE target END END AS label FROM clicks""")
def click_labels(spark, sf):
    names = spark.range(1).select(F.lit("t1").alias("target"), F.lit("One").alias("label"))
    k = F.col("id") % 7
    target = F.when(k == 0, "").when(k == 1, "📍 Use my current location").when(k == 2, "22K").when(k == 3, "📍 Near me").when(k == 4, F.lit(None)).when(k == 5, "₹").otherwise(F.col("target"))
    return traffic.friendly_label(B.clicks(spark, sf).drop("label").withColumn("target", target), names).select("id", "label")


# ---- samples
@query(f"WITH {B.OFFERS}, r AS (SELECT *, row_number() OVER (PARTITION BY brand, category ORDER BY confidence DESC, url) AS rn FROM offers) SELECT brand, category, url, pct FROM r WHERE rn <= 3")
def top3_examples(spark, sf):
    return sampling.top_examples(B.offers(spark, sf), ["brand", "category"], "confidence", "url").select("brand", "category", "url", "pct")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE rn = 1")
def newest_per_key(spark, sf):
    return sampling.newest_per_key(table(spark, sf, "orders"), F.col("o_custkey"), [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


TIER = f"""{B.OFFERS}, tr AS (SELECT *, count(*) OVER (PARTITION BY category) AS pool, row_number() OVER (PARTITION BY category ORDER BY id) AS rn FROM offers),
ts AS (SELECT * FROM tr WHERE rn <= CASE WHEN pool >= 500 THEN 150 WHEN pool >= 100 THEN 60 ELSE greatest(20, least(pool, 60)) END)"""


@query(f"WITH {TIER} SELECT id, brand, category, pool, rn::INT AS rn FROM ts")
def tiered_sample(spark, sf):
    return sampling.tiered_sample(B.offers(spark, sf), ["category"], "id").select("id", "brand", "category", "pool", "rn")


RR = f"""{B.OFFERS}, rr0 AS (SELECT *, row_number() OVER (PARTITION BY brand, category ORDER BY id) AS rn FROM offers), rr AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY rn, category) AS turn FROM rr0)"""


def _turns(spark, sf):
    o = B.offers(spark, sf)
    rn = sampling.Window.partitionBy("brand", "category").orderBy("id")
    return sampling.round_robin(o.withColumn("rn", F.row_number().over(rn)), "brand", "category", cap=600)


@query(f"WITH {RR} SELECT id, brand, category, turn::INT AS turn FROM rr WHERE turn <= 600")
def round_robin(spark, sf):
    return _turns(spark, sf).select("id", "brand", "category", "turn")


@query(f"""WITH {RR}, g AS (SELECT brand, count(*) AS n, count(*) FILTER (hit) AS h FROM rr WHERE turn <= 25 GROUP BY 1) SELECT id, brand, turn::INT AS turn FROM rr JOIN g USING (brand) WHERE turn <= 600 AND (turn <= 25 OR NOT (n >= 25 AND h = 0))""")
def probe_gate(spark, sf):
    return sampling.probe_gate(_turns(spark, sf), "brand").select("id", "brand", "turn")


@query(f"WITH {B.OFFERS} SELECT brand, category, array_to_string(list_transform(list_sort(list(pct)), lambda x: CAST(round(x * 10000) AS BIGINT)), ',') AS pcts, count(pct) AS hits, count(*) FILTER (hit) AS proxied FROM offers GROUP BY ALL")
def record_fold(spark, sf):
    r = sampling.fold_records(B.offers(spark, sf), ["brand", "category"], "pct", "hit")
    whole = F.transform("pcts", lambda x: F.round(x * 10000).cast("long").cast("string"))
    return r.select("brand", "category", F.array_join(whole, ",").alias("pcts"), "hits", "proxied")


@query(f"WITH {B.OFFERS} SELECT brand, arg_max(category, CAST(id AS VARCHAR)) FILTER (hit) AS strategy, count(*) FILTER (hit)::INT AS hits, count(*) FILTER (NOT hit)::INT AS misses, CAST(count(*) FILTER (hit) AS DOUBLE) / count(*) AS hit_rate FROM offers GROUP BY 1")
def profile_hits(spark, sf):
    res = B.offers(spark, sf).select("brand", F.when(F.col("hit"), F.col("category")).alias("strategy"), F.col("id").cast("string").alias("at"))
    p = sampling.updated_profiles(spark.createDataFrame([], readers.PROFILE), res)
    return sampling.profile_report(p).select("brand", "strategy", F.col("hits").cast("int").alias("hits"), F.col("misses").cast("int").alias("misses"), "hit_rate")


# ---- pages
#: Ends of product URLs, dealt over the pages.
SLUGS = ["gold-mangalsutra", "stud-earrings-22k", "jhumka_set", "bangle-diamonds", "kada", "ring", "diamond-ring", "steel-bangle", "opal-stud", "gem/kada", "chain", "navratna-ring", "americandiamond-kada", "studded-ring", "keyring-gold", "gemini-bangle"]
SLUG_SQL = "CASE page_id % 16 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SLUGS)) + " END"
PATHS = "u AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)) AS p FROM pages)"


@query(f"""WITH u AS (SELECT page_id, lower(regexp_replace(url, '[?#].*$', '') || '/p/' || {SLUG_SQL}) AS s FROM pages)
SELECT page_id, CASE WHEN regexp_matches(s, '\\b(silver|platinum|titanium|steel)\\b') THEN NULL
 WHEN regexp_matches(s, '\\b(diamonds?|solitaire|studded|gemstones?|kundan|polki|pearls?|ruby|rubies|emeralds?|sapphires?|americandiamond|cz|zircon|zirconia|topaz|garnet|onyx|opal|turquoise|moissanite|navratna|navratra|stones?|gems?)\\b') THEN NULL
 WHEN contains(s, 'mangalsutra') THEN 'Mangalsutra' WHEN contains(s, 'earring') OR contains(s, 'jhumk') OR contains(s, 'stud') THEN 'Earrings' WHEN contains(s, 'bangle') OR contains(s, 'kada') THEN 'Bangle' WHEN contains(s, 'ring') THEN 'Ring' END AS category FROM u""")
def url_category(spark, sf):
    slug = F.element_at(F.array(*map(F.lit, SLUGS)), (F.col("page_id") % 16 + 1).cast("int"))
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/p/"), slug)
    return table(spark, sf, "pages").select("page_id", pages.categorize(url).alias("category"))


@query("SELECT page_id, url FROM pages WHERE contains(url, '/') AND page_id % 2 = 0")
def url_product_filter(spark, sf):
    config = spark.createDataFrame([("a", "/"), ("b", "/no-such-path/")], "brand string, require_path string")
    p = table(spark, sf, "pages").withColumn("brand", F.when(F.col("page_id") % 2 == 0, "a").otherwise("b"))
    return pages.product_pages(p, config).select("page_id", "url")


@query(f"""WITH n AS (SELECT p_partkey, lower(p_name || CASE p_partkey % 3 WHEN 0 THEN ' gold coin 24k' WHEN 1 THEN ' gold silver' ELSE ' 22 K diamond' END) AS t FROM part)
SELECT p_partkey, (CASE WHEN regexp_matches(t, '\\bcoins?\\b|\\bbars?\\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(t, '24[- ]?k') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '22[- ]?k') THEN 2 ELSE 0 END + CASE WHEN contains(t, 'gold') THEN 1 ELSE 0 END
 - CASE WHEN regexp_matches(t, 'diamond|platinum|silver|solitaire|gemstone|pearl') THEN 3 ELSE 0 END)::INT AS score FROM n""")
def product_score(spark, sf):
    k = F.col("p_partkey") % 3
    text = F.concat("p_name", F.when(k == 0, " gold coin 24k").when(k == 1, " gold silver").otherwise(" 22 K diamond"))
    return table(spark, sf, "part").select("p_partkey", pages.product_score(text).alias("score"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+') AS o, unnest(list_distinct(regexp_extract_all(html, 'href="([^"#?]+)"', 1))) AS x FROM pages)
SELECT page_id, CASE WHEN regexp_matches(x, '^https?://') THEN x WHEN starts_with(x, '//') THEN 'https:' || x WHEN starts_with(x, '/') THEN o || x ELSE o || '/' || x END AS url FROM h""")
def page_links(spark, sf):
    return pages.links(table(spark, sf, "pages"))


AGED = """a AS (SELECT page_id, DATE '2024-01-01' + CAST(page_id % 40 AS INT) AS day, '<html><head><meta name="viewport" content="w">' || CASE WHEN page_id % 2 = 0 THEN '<meta name="robots" content="index, follow">' ELSE '' END || '</head>' || html AS html FROM pages)"""


@query(f"""WITH {AGED} SELECT page_id, CASE WHEN day < DATE '2024-01-20' THEN 'noindex, follow' WHEN page_id % 2 = 0 THEN 'index, follow' END AS robots FROM a""")
def robots_age_out(spark, sf):
    k = F.col("page_id")
    head = F.concat(F.lit('<html><head><meta name="viewport" content="w">'), F.when(k % 2 == 0, '<meta name="robots" content="index, follow">').otherwise(""), F.lit("</head>"))
    p = table(spark, sf, "pages").select("page_id", F.date_add(_day("2024-01-01"), (k % 40).cast("int")).alias("day"), F.concat(head, "html").alias("html"))
    aged = pages.age_out(pages.age_out(p, "day", _day("2024-01-20")), "day", _day("2024-01-20"))
    return aged.select("page_id", pages.robots_meta(F.col("html")).alias("robots"))


@query("""WITH d AS (SELECT url AS loc, DATE '2024-01-01' + CAST(page_id % 40 AS INT) AS day, page_id FROM pages)
SELECT loc, DATE '2024-02-01' AS lastmod, 'daily' AS changefreq, 1.0::DOUBLE AS priority FROM d WHERE page_id % 10 = 0 UNION ALL SELECT loc, day, 'monthly', 0.5 FROM d WHERE page_id % 10 <> 0 AND day >= DATE '2024-02-01' - 3""")
def sitemap_rows(spark, sf):
    p = table(spark, sf, "pages").select(F.col("url").alias("loc"), F.date_add(_day("2024-01-01"), (F.col("page_id") % 40).cast("int")).alias("day"), "page_id")
    static = p.filter("page_id % 10 = 0").select("loc", F.lit("daily").alias("changefreq"), F.lit(1.0).alias("priority"))
    return pages.sitemap_rows(static, p.filter("page_id % 10 <> 0"), _day("2024-02-01"), 3)


@query("""WITH r AS (SELECT url, 0 AS route, page_id AS place FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT url, 1, page_id FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 2, page_id FROM pages)
SELECT url, CASE route WHEN 0 THEN 'seed' WHEN 1 THEN 'map' ELSE 'list' END AS category, route::INT AS route, place FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY route, place) AS rn FROM r) WHERE rn = 1""")
def candidate_union(spark, sf):
    p = table(spark, sf, "pages").select("url", F.col("page_id").alias("place"))
    return sampling.candidates(p.filter("place % 3 = 0").withColumn("category", F.lit("seed")), p.filter("place % 2 = 0").withColumn("category", F.lit("map")), p.withColumn("category", F.lit("list")))


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 <> 0")
def except_pages(spark, sf):
    p = table(spark, sf, "pages").select("page_id")
    return p.exceptAll(p.filter("page_id % 3 = 0").union(p.filter("page_id % 5 = 0 and page_id % 3 <> 0")))


@query("""SELECT p_partkey AS page_id, k AS purity, CAST(7000 + p_partkey % 1000 AS DOUBLE) * f AS value FROM part, (VALUES ('24K', CAST(1 AS DOUBLE)), ('22K', CAST(0.5 AS DOUBLE))) v(k, f) WHERE p_partkey % 4 <> 0""")
def rate_api_unpivot(spark, sf):
    k = F.col("p_partkey")
    body = F.format_string('{"Status":%d,"Rate24K":"%d","Rate22K":"%.1f","Rate18K":null}', F.when(k % 4 == 0, 500).otherwise(200), 7000 + k % 1000, (7000 + k % 1000) * F.lit(0.5))
    return readers.read_rate_api_json(table(spark, sf, "part").select(k.alias("page_id"), body.alias("body")))


@query("""WITH x AS (SELECT o_orderkey, CAST(floor(o_totalprice * (1 + o_orderkey % 3 * 100)) AS BIGINT) AS v FROM orders), y AS (SELECT *, CAST(v AS VARCHAR) AS s FROM x)
SELECT o_orderkey, '₹' || CASE WHEN length(s) <= 3 THEN s ELSE reverse(regexp_replace(reverse(left(s, length(s) - 3)), '(\\d\\d)', '\\1,', 'g')) || ',' || right(s, 3) END AS shown FROM y""".replace("reverse(regexp_replace(", "ltrim(reverse(regexp_replace(").replace("'\\1,', 'g'))", "'\\1,', 'g')), ',')"))
def inr_format(spark, sf):
    v = F.floor(F.col("o_totalprice") * (1 + F.col("o_orderkey") % 3 * 100))
    return table(spark, sf, "orders").select("o_orderkey", S.inr(v).alias("shown"))


@query("SELECT n_nationkey, lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug FROM nation")
def slugs(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", S.slug(F.col("n_name")).alias("slug"))


# ---- subscribers
MERGED = """lastp AS (SELECT key, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(city, seq) FILTER (city IS NOT NULL) AS city, arg_max(offers_optin, seq) FILTER (offers_optin IS NOT NULL) AS offers_optin, arg_max(signup_method, seq) FILTER (signup_method IS NOT NULL) AS signup_method FROM payloads WHERE key IS NOT NULL GROUP BY 1)"""
COLS = ["name", "city", "offers_optin", "signup_method"]


@query(f"""WITH {B.SUBS}, {B.PAYLOADS}, {MERGED} SELECT coalesce(s.key, n.key) AS key, coalesce(n.name, s.name) AS name, coalesce(n.city, s.city) AS city, CASE WHEN n.key IS NOT NULL THEN coalesce(n.offers_optin, true) ELSE s.offers_optin END AS offers_optin,
CASE WHEN s.signup_method = 'google' THEN 'google' ELSE coalesce(n.signup_method, s.signup_method) END AS signup_method, CASE WHEN n.key IS NOT NULL THEN DATE '2024-02-01' ELSE s.updated_at END AS updated_at FROM subs s FULL JOIN lastp n ON s.key = n.key""")
def subscriber_merge(spark, sf):
    return subscribers.merge_subscribers(B.subscribers(spark, sf), B.payloads(spark, sf), COLS, _day("2024-02-01"))


@query(f"""WITH {B.SUBS}, {B.PAYLOADS}, {MERGED} SELECT coalesce(s.key, n.key) AS key, coalesce(n.name, s.name) AS name, coalesce(n.city, s.city) AS city, CASE WHEN s.key IS NOT NULL THEN s.offers_optin ELSE n.offers_optin END AS offers_optin,
coalesce(n.signup_method, s.signup_method) AS signup_method, CASE WHEN n.key IS NOT NULL THEN DATE '2024-02-01' ELSE s.updated_at END AS updated_at FROM subs s FULL JOIN lastp n ON s.key = n.key""")
def subscriber_merge_keep_optin(spark, sf):
    return subscribers.merge_subscribers(B.subscribers(spark, sf), B.payloads(spark, sf), COLS, _day("2024-02-01"), "keep_optin")


PENDING = f"{B.SUBS}, pend AS (SELECT * FROM subs WHERE unsub_token IS NOT NULL AND (last_emailed IS NULL OR last_emailed < DATE '2024-02-01'))"


@query(f"WITH {PENDING} SELECT id, email FROM pend")
def pending_digest(spark, sf):
    return subscribers.pending_digest(B.subscribers(spark, sf), _day("2024-02-01")).select("id", "email")


@query(f"""WITH {PENDING}, {B.LIVE}, {B.STATS} SELECT id, email, string_split(pend.name, ' ')[1] AS first_name, 'https://example.org/unsubscribe?token=' || unsub_token AS unsubscribe, {D('m')} AS rate_24k, {D('m * ' + FRAC("'22K'"))} AS rate_22k, lowest, lowest_brand, n FROM pend, stats""")
def digest_rows(spark, sf):
    p = subscribers.pending_digest(B.subscribers(spark, sf), _day("2024-02-01"))
    return subscribers.digest_rows(p, market_snapshot(spark, sf), "https://example.org/")


@query(f"WITH {B.SUBS} SELECT id, CASE WHEN id % 2 = 0 THEN DATE '2024-02-02' ELSE last_emailed END AS last_emailed FROM subs")
def mark_sent(spark, sf):
    s = B.subscribers(spark, sf)
    res = s.select("id", (F.col("id") % 2 == 0).alias("ok"))
    return subscribers.mark_sent(s, res, _day("2024-02-02")).select("id", "last_emailed")


@query(f"WITH {B.SUBS} SELECT left(o_orderpriority, 200) AS reason FROM orders WHERE 'tok' || o_custkey IN (SELECT unsub_token FROM subs WHERE unsub_token IS NOT NULL)")
def accept_reasons(spark, sf):
    r = table(spark, sf, "orders").select(F.concat(F.lit("tok"), F.col("o_custkey").cast("string")).alias("token"), F.col("o_orderpriority").alias("reason"))
    return subscribers.accept_reasons(r, B.subscribers(spark, sf))


@query(f"WITH {B.SUBS} SELECT id FROM subs WHERE unsub_token IS NULL OR unsub_token NOT IN (SELECT 'tok' || o_custkey FROM orders)")
def unsubscribed(spark, sf):
    t = table(spark, sf, "orders").select(F.concat(F.lit("tok"), F.col("o_custkey").cast("string")).alias("token"))
    return subscribers.remove_unsubscribed(B.subscribers(spark, sf), t).select("id")


# ---- search
SEARCH = "se AS (SELECT CAST(ts AS DATE) AS date, CASE event_id % 3 WHEN 0 THEN '/news/daily/' WHEN 1 THEN '/news/' ELSE '/' END || (event_id % 50) AS page, event_id % 7 AS clicks, 10 + event_id % 90 AS impressions, 1 + CAST(event_id % 40 AS DOUBLE) / 10 AS position FROM events)"


def _search(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    page = F.concat(F.when(k % 3 == 0, "/news/daily/").when(k % 3 == 1, "/news/").otherwise("/"), (k % 50).cast("string"))
    rows = e.select(F.to_date("ts").alias("date"), F.array(page).alias("keys"), (k % 7).alias("clicks"), (10 + k % 90).alias("impressions"), F.lit(0.0).alias("ctr"), (1 + (k % 40).cast("double") / 10).alias("position"))
    return rows.select("date", F.try_element_at("keys", F.lit(1)).alias("page"), "clicks", "impressions", "position")


@query(f"WITH {SEARCH} SELECT date, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, {D('CAST(sum(clicks) AS DOUBLE) / sum(impressions)', 6)} AS ctr, {D('sum(position * impressions) / sum(impressions)', 4)} AS position FROM se GROUP BY 1")
def search_trend(spark, sf):
    return search.trend(_search(spark, sf))


@query(f"WITH {SEARCH} SELECT CASE WHEN contains(page, '/news/daily/') THEN 'daily' WHEN contains(page, '/news/') THEN 'recap' ELSE 'other' END AS page_group, count(DISTINCT page) AS pages, sum(clicks)::BIGINT AS clicks FROM se GROUP BY 1")
def search_groups(spark, sf):
    return search.groups(_search(spark, sf))


@query(f"WITH {SEARCH} SELECT page, sum(clicks)::BIGINT AS clicks FROM se GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def search_top(spark, sf):
    return search.top_pages(_search(spark, sf))


# ---- extraction: pages are rendered from products, read, and compared with arithmetic on the products
from ..operators import extract_making as EM  # noqa: E402
from ..operators import extract_rates as ER  # noqa: E402
from ..streaming import jobs  # noqa: E402

#: Layout of a page for each extractor; %1$d is the per-gram price, %2$s the karat, %3$s its fineness, %4$d ten times the price.
RATE_PAGES = {
    "rate_cards": '<p class="goldCard--rate"> ₹%4$d <span>/10gm</span></p> <p class="goldCard--karat">%2$s Karat</p>',
    "rows": "<table><tr><th>Purity</th><th>Rate</th></tr><tr><td>Gold %2$s KT</td><td>₹ %1$d</td></tr></table>",
    "product_breakup": '{"metal_price": %4$d, "net_weight": "10", "option1": "%2$sKT"}',
    "json_breakup": '{"title":"%3$s Kt Yellow Gold","rate":"Rs. %1$d/g"}',
    "labeled": "<div>%2$s KT today Rs. %1$d /gm</div>",
    "value_karat": "<div>%1$d /gms for %2$sKT (916)</div>",
    "value_ct": "<div>price %1$d plain /gram (%2$sct)</div>",
    "value_per_gm": "<div>Rs %1$d per gm (%2$skt)</div>",
    "pregst": "<div>24K pure Rs %1$d + 3% GST</div>",
    "gold_value": "<div>%2$sK Gold 10 g ₹ %4$d</div>",
    "headline": "<div>%2$sKt Gold Rate today 1 G ₹ %1$d</div>",
    "proximity": "<div>our %2$sK price is Rs %1$d only</div>",
}
KARAT_SQL = "CASE p_partkey % 4 WHEN 0 THEN '24' WHEN 1 THEN '22' WHEN 2 THEN '18' ELSE '14' END"


def rate_pages(spark, sf, layout):
    k = F.col("p_partkey")
    karat = F.when(k % 4 == 0, "24").when(k % 4 == 1, "22").when(k % 4 == 2, "18").otherwise("14")
    mark = F.when(k % 4 == 0, "999").when(k % 4 == 1, "916").when(k % 4 == 2, "750").otherwise("583")
    price = 8000 + k % 2000
    html = F.lit(layout)
    for a, b in (("%1$d", price.cast("string")), ("%2$s", karat), ("%3$s", mark), ("%4$d", (price * 10).cast("string"))):
        html = F.replace(html, F.lit(a), b)
    return table(spark, sf, "part").select(k.alias("page_id"), F.concat(F.lit("<html><body>"), html, F.lit("</body></html>")).alias("html"))


def _rates_query(name, layout):
    karat = "'24K'" if name == "pregst" else f"{KARAT_SQL} || 'K'"

    def run(spark, sf):
        return ER.extract_rates(rate_pages(spark, sf, layout), {name: ER.EXTRACTORS[name]})

    run.__name__ = f"extract_rates_{name}"
    query(f"SELECT p_partkey AS page_id, '{name}' AS extractor, {karat} AS purity, CAST(8000 + p_partkey % 2000 AS DOUBLE) AS value, 1::BIGINT AS n FROM part")(run)


for _name, _layout in RATE_PAGES.items():
    _rates_query(_name, _layout)


def _of(names, key):
    return f"CASE {key} % {len(names) + 2} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def _embedded(spark, sf, layouts, values):
    """The table's pages, each with one of the layouts in its body; two pages of each round stay as they are."""
    k, n = F.col("page_id"), len(layouts) + 2
    html = F.element_at(F.array(*(F.lit(x) for x in layouts)), (k % n + 1).cast("int"))
    html = F.when(k % n < len(layouts), html).otherwise("")
    for a, b in values(k).items():
        html = F.replace(html, F.lit(a), b.cast("string"))
    return table(spark, sf, "pages").select("page_id", F.concat(F.col("html"), F.lit("<p>"), html, F.lit("</p>")).alias("html"))


def _rate_values(k):
    karat = F.when(k % 4 == 0, "24").when(k % 4 == 1, "22").when(k % 4 == 2, "18").otherwise("14")
    mark = F.when(k % 4 == 0, "999").when(k % 4 == 1, "916").when(k % 4 == 2, "750").otherwise("583")
    return {"%1$d": 8000 + k % 2000, "%2$s": karat, "%3$s": mark, "%4$d": (8000 + k % 2000) * 10}


@query(f"""SELECT page_id, {_of(list(RATE_PAGES), 'page_id')} AS extractor, CASE WHEN {_of(list(RATE_PAGES), 'page_id')} = 'pregst' THEN '24K' ELSE {KARAT_SQL.replace('p_partkey', 'page_id')} || 'K' END AS purity,
CAST(8000 + page_id % 2000 AS DOUBLE) AS value, 1::BIGINT AS n FROM pages WHERE page_id % 14 < 12""")
def extract_rates(spark, sf):
    """All twelve extractors over the pages table."""
    return ER.extract_rates(_embedded(spark, sf, list(RATE_PAGES.values()), _rate_values))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'MISLABELLED' ELSE 'no values' END AS verdict FROM pages")
def accept_rates(spark, sf):
    row = lambda karat, price: f"<tr><td>{karat} KT</td><td>₹ {price}</td></tr>"
    k = F.col("page_id") % 3
    rows = F.when(k == 0, row(24, "12,000") + row(22, "11,000")).when(k == 1, row(24, "11,000") + row(22, "11,900")).otherwise("<tr><td>24 KT</td><td>closed</td></tr>")
    p = table(spark, sf, "pages").select("page_id", F.concat("html", F.lit("<table>"), rows, F.lit("</table>")).alias("html"))
    return ER.accept_rates(p, ER.extract_rates(p))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END::INT AS snapshot, CASE WHEN page_id % 2 = 0 THEN 'labeled' ELSE 'proximity' END AS extractor, 9500::DOUBLE AS value FROM pages")
def prefer_structured(spark, sf):
    """A saved page, and the same page rendered: where the rendered one has a structured rate, that one stays."""
    p = table(spark, sf, "pages").select("page_id")
    near, structured = "<p>our 22K price is Rs 9500 only</p>", "<p>22 KT today Rs 9500 / gm</p>"
    static = p.withColumn("html", F.lit(near)).withColumn("snapshot", F.lit(0))
    rendered = p.withColumn("html", F.when(F.col("page_id") % 2 == 0, structured).otherwise(near)).withColumn("snapshot", F.lit(1))
    found = [ER.found_rates(x).withColumn("snapshot", F.lit(i)) for i, x in enumerate((static, rendered))]
    return ER.prefer_structured(found[0].unionByName(found[1])).select("page_id", "snapshot", "extractor", "value")


#: %1$s gold value, %2$s making charge, %3$s tax, %4$s total, %5$s percent.
MAKING_PAGES = {
    "json_typed_percent": '{"making_charge_type":"percentage","making_charge":%5$s,"gold_value":"%1$s"}',
    "weight_rate_join": 'metalPriceConfig = {"gold_price_22k":%1$s}; {"metal_type":"gold","purity":"22K","metal_weight":1.0,"diamond_charges":null,"x":1,"making_charges":%2$s}',
    "escaped_json": '{\\"product_price_details\\":{\\"metal_value\\":%1$s,\\"making_charge\\":%2$s,\\"gst_with_discount\\":%3$s,\\"grand_total_with_discount\\":%4$s}}',
    "rsc_breakup": '{\\"price\\":%1$s,\\"weight\\":2.1,\\"priceType\\":\\"metalPrice\\"} {\\"price\\":%2$s,\\"priceType\\":\\"makingCharge\\"}',
    "json_arrays": '{"gold":[{"k":1,"value":"Rs. %1$s"}],"making":[{"k":2,"value":"Rs. %2$s"}],"gst":[{"value":"Rs. %3$s"}],"total":[{"value":"Rs. %4$s"}]}',
    "json_flat": '{"gold_value":"%1$s","making_charges":%2$s,"tax":%3$s,"total_price":"%4$s"}',
    "id_spans": '<span id="MetalValue">%1$s</span><span id="MakingCharges">%2$s</span><span id="GrandTotal">%4$s</span>',
    "js_literal": "var v = {metal_price: %1$s, making_charges: %2$s, price: 1};",
    "dom_section": '<section id="price-breakup"><p>Gold Value ₹ %1$s</p><p>Making Charges ₹ %2$s</p><p>GST ₹ %3$s</p><p>Grand Total ₹ %4$s</p></section>',
    "table_rows": "<table><tr><td>Gold Value</td><td>2.1 g</td><td>₹ %1$s</td></tr><tr><td>Making Charges</td><td>-</td><td>₹ %2$s</td></tr></table>",
    "direct_percent": "<p>Making charges: %5$s% of gold value</p>",
    "labelled_text": "<p>Metal Value ₹ %1$s</p> <p>Value Addition ₹ %2$s</p> <p>Total ₹ %4$s</p>",
}
CONFIDENCE = {"json_typed_percent": 0.9, "weight_rate_join": 0.55, "escaped_json": 0.99, "rsc_breakup": 0.55, "json_arrays": 0.99, "json_flat": 0.99, "id_spans": None, "js_literal": 0.55, "dom_section": 0.99, "table_rows": 0.55, "direct_percent": 0.7, "labelled_text": None}


def making_pages(spark, sf, layout):
    k = F.col("p_partkey")
    gold, making = 50000 + k % 1000 * 10, 5000 + k % 700
    tax = F.floor((gold + making) * 0.03).cast("long")
    html = F.lit(layout)
    for a, b in (("%1$s", gold), ("%2$s", making), ("%3$s", tax), ("%4$s", gold + making + tax), ("%5$s", 3 + k % 20)):
        html = F.replace(html, F.lit(a), b.cast("string"))
    return table(spark, sf, "part").select(k.alias("page_id"), F.col("p_brand").alias("brand"), F.concat(F.lit("<html>"), html, F.lit("</html>")).alias("html"))


def _making_query(name, layout):
    percent = name in ("json_typed_percent", "direct_percent")
    pct = "CAST(3 + p_partkey % 20 AS DOUBLE)" if percent else D("CAST(5000 + p_partkey % 700 AS DOUBLE) / CAST(50000 + p_partkey % 1000 * 10 AS DOUBLE) * 100", 1)

    def run(spark, sf):
        return EM.probe_making(making_pages(spark, sf, layout), {name: EM.STRATEGIES[name]}).select("page_id", "strategy", "making_pct")

    run.__name__ = f"extract_making_{name}"
    query(f"SELECT p_partkey AS page_id, '{name}' AS strategy, {pct} AS making_pct FROM part")(run)


for _name, _layout in MAKING_PAGES.items():
    _making_query(_name, _layout)


#: What a page of each layout gives where all strategies are tried: another strategy is as good or better on some.
WINNERS = {n: n for n in MAKING_PAGES}


def _making_values(k):
    gold, making = 50000 + k % 1000 * 10, 5000 + k % 700
    tax = F.floor((gold + making) * 0.03).cast("long")
    return {"%1$s": gold, "%2$s": making, "%3$s": tax, "%4$s": gold + making + tax, "%5$s": 3 + k % 20}


MAKING_PCT = D("CAST(5000 + page_id % 700 AS DOUBLE) / CAST(50000 + page_id % 1000 * 10 AS DOUBLE) * 100", 1)


@query(f"""SELECT page_id, {_of(list(WINNERS.values()), 'page_id')} AS strategy, CASE WHEN page_id % 14 IN (0, 10) THEN CAST(3 + page_id % 20 AS DOUBLE) ELSE {MAKING_PCT} END AS making_pct, page_id % 14 = 8 AS by_profile FROM pages WHERE page_id % 14 < 12""")
def extract_making(spark, sf):
    """All twelve strategies over the pages table; a profile names the strategy of one kind of page."""
    p = _embedded(spark, sf, list(MAKING_PAGES.values()), _making_values)
    p = p.withColumn("brand", F.concat(F.lit("b"), (F.col("page_id") % 14).cast("string")))
    profiles = spark.createDataFrame([("b8", "dom_section"), ("b9", "json_flat"), ("b20", "id_spans")], "brand string, strategy string")
    return EM.extract_making(p, profiles).select("page_id", "strategy", "making_pct", "by_profile")


@query("SELECT page_id, 10.0::DOUBLE AS making_pct FROM pages WHERE page_id % 2 = 0")
def extract_variants(spark, sf):
    """Pages with several variants, the first one priced in percent; and pages with promotions and nothing else."""
    variant = '{"metal_type":"gold","purity":"%s","metal_weight":%s,"diamond_charges":null,"making_charges":%s,"remarks":"%s"}'
    several = 'metalPriceConfig = {"gold_price_22k":9000,"gold_price_18k":7000};[' + ",".join([variant % ("22K", 2, 14, "percentage"), variant % ("14K", 2, 1400, "flat"), variant % ("18K", 2, 1400, "flat")]) + "]"
    promo = "<p>Flat 20% off on making charges, use CODE20</p><p>Discount on making charges ₹ 5,000, gold value ₹ 20,000 off on total</p>"
    k = F.col("page_id") % 2
    p = table(spark, sf, "pages").select("page_id", F.concat(F.col("html"), F.when(k == 0, several).otherwise(promo)).alias("html"))
    return EM.extract_making(p).select("page_id", "making_pct")


@query("""WITH l AS (SELECT DISTINCT p_partkey % 4 AS k, p_type AS t FROM part) SELECT CASE k WHEN 0 THEN 'Making Charge ' WHEN 1 THEN 'goldPrice ' ELSE 'Colored Stone ' END || t AS label,
CASE k WHEN 0 THEN 'making charge ' WHEN 1 THEN 'gold price ' ELSE 'colored stone ' END || lower(t) AS norm, CASE k WHEN 0 THEN 'making_charge' WHEN 1 THEN 'gold_value' ELSE 'stone_value' END AS concept, CAST(0.96 AS DOUBLE) AS score FROM l WHERE k <> 2""")
def label_concepts(spark, sf):
    return EM.label_concepts(table(spark, sf, "part").select(F.concat(F.element_at(F.array(*map(F.lit, ["Making Charge ", "goldPrice ", "Delivery ", "Colored Stone "])), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_type")).alias("label")))


# ---- streams: file streams over the tables, run until what is there is in
def _paths(spark, name):
    import uuid

    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{at}/table", f"{at}/checkpoint"


def _stream(spark, sf, name):
    """The table's file as a stream (the pattern matches that one file or folder)."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@query(f"{V} SELECT day, count(*) AS views FROM views WHERE day < (SELECT max(day) FROM views) - 2 GROUP BY 1")
def stream_daily_hits(spark, sf):
    """Days that the watermark has closed; the batch rollups stay the truth."""
    out, at = _paths(spark, "hits")
    v = _stream(spark, sf, "events").filter(F.col("event_type").isin("view", "signup")).select(F.col("ts").cast("timestamp").alias("ts"))
    jobs.to_table(jobs.daily_views(v), out, at)
    last = B.views(spark, sf).agg(F.max("day").alias("last"))
    return spark.read.parquet(out).crossJoin(F.broadcast(last)).filter("day < date_sub(last, 2)").select("day", "views")


# ---- runs
from . import runs  # noqa: E402

RUN = f"""b AS (SELECT s_suppkey AS brand_id FROM supplier), l AS (SELECT brand_id, {D("CAST(8000 + brand_id % 2000 AS DOUBLE) / (CASE brand_id % 4 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(22 AS DOUBLE)/24 WHEN 2 THEN CAST(0.75 AS DOUBLE) ELSE CAST(14 AS DOUBLE)/24 END)")} AS canonical FROM b WHERE brand_id % 6 <> 0),
m AS (SELECT median(canonical) AS m, count(*) AS n FROM l), st AS (SELECT brand_id, 9000.0::DOUBLE AS canonical FROM b WHERE brand_id % 12 = 0),
m2 AS (SELECT median(canonical) AS m FROM (SELECT canonical FROM l UNION ALL SELECT canonical FROM st))"""


@query(f"""WITH {RUN} SELECT brand_id, DATE '2024-02-01' AS rate_date, canonical, CASE WHEN n >= 5 AND abs(canonical - m) / m > CAST(0.04 AS DOUBLE) THEN 'quarantined' ELSE 'published' END AS status, 'extracted' AS method FROM l, m
UNION ALL SELECT brand_id, DATE '2024-02-01', canonical, 'published', 'carried' FROM st
UNION ALL SELECT brand_id, DATE '2024-02-01', {D('m2.m')}, 'estimated', 'reference-median' FROM b, m2 WHERE brand_id % 6 = 0 AND brand_id % 12 <> 0""")
def rates_run(spark, sf):
    k = F.col("s_suppkey")
    karat = F.when(k % 4 == 0, "24").when(k % 4 == 1, "22").when(k % 4 == 2, "18").otherwise("14")
    price = (8000 + k % 2000).cast("string")
    html = F.when(k % 5 < 2, F.concat(F.lit("<table><tr><td>Gold "), karat, F.lit(" KT</td><td>₹ "), price, F.lit("</td></tr></table>")))
    html = html.when(k % 5 == 2, F.concat(F.lit("<p>"), karat, F.lit(" KT today Rs. "), price, F.lit(" /gm</p>"))).when(k % 5 == 3, F.concat(F.lit("<p>Rs "), price, F.lit(" per gm ("), karat, F.lit("kt)</p>")))
    html = html.otherwise(F.concat(F.lit("<p>our "), karat, F.lit("K price is Rs "), price, F.lit(" only</p>")))
    s = table(spark, sf, "supplier")
    pages_ = s.filter(k % 6 != 0).select(k.alias("page_id"), html.alias("html"))
    brands = s.select(k.alias("brand_id"), F.lit(False).alias("includes_gst"))
    # an earlier row of the day for every second brand without a page and for some that have one, and a row of the day before
    row = lambda day, price: [k.cast("long").alias("brand_id"), _day(day).alias("rate_date"), F.lit(price).alias("canonical"), F.lit("published").alias("status"), F.lit("carried").alias("method"), F.lit(0).cast("long").alias("seq")]
    stored = s.filter((k % 12 == 0) | (k % 6 == 1)).select(*row("2024-02-01", 9000.0)).unionByName(s.select(*row("2024-01-31", 1.0)))
    return runs.rates_run(pages_, brands, stored, _day("2024-02-01"))


@query(f"""WITH x AS (SELECT p_brand AS brand, p_type AS category, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand, p_type) AS pool,
{D("CAST(5000 + p_partkey % 700 AS DOUBLE) / CAST(50000 + p_partkey % 1000 * 10 AS DOUBLE) * 100", 1)} AS pct FROM part), s AS (SELECT * FROM x WHERE rn <= CASE WHEN pool >= 500 THEN 150 WHEN pool >= 100 THEN 60 ELSE greatest(20, least(pool, 60)) END),
t AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY rn, category) AS turn FROM s), u AS (SELECT * FROM t WHERE turn <= 600),
m AS (SELECT brand, category, median(pct) AS md, count(*) AS n FROM u GROUP BY ALL), d AS (SELECT u.*, md, n, abs(pct - md) AS dv FROM u JOIN m USING (brand, category)), a AS (SELECT brand, category, median(dv) AS mad FROM d GROUP BY ALL),
k AS (SELECT d.*, CASE WHEN n < 4 OR mad = 0 THEN true ELSE abs(CAST(0.6745 AS DOUBLE) * (pct - md) / mad) <= CAST(3.5 AS DOUBLE) END AS kept FROM d JOIN a USING (brand, category))
SELECT brand, category, count(*) FILTER (kept) AS items, {D('median(pct) FILTER (kept)', 1)} AS median_pct, {D('min(pct) FILTER (kept)', 1)} AS min_pct, {D('max(pct) FILTER (kept)', 1)} AS max_pct, count(*) FILTER (NOT kept) AS rejected,
CASE WHEN count(*) FILTER (kept) >= 12 THEN 'high' WHEN count(*) FILTER (kept) >= 5 THEN 'medium' WHEN count(*) FILTER (kept) > 0 THEN 'low' ELSE 'none' END AS confidence FROM k GROUP BY brand, category""")
def charges_run(spark, sf):
    kinds = [making_pages(spark, sf, MAKING_PAGES[n]).filter(F.col("page_id") % 3 == i) for i, n in enumerate(("json_flat", "table_rows", "labelled_text"))]
    p = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    cat = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_type").alias("category"), F.concat(F.lit("/products/"), F.col("p_partkey").cast("string")).alias("url"))
    profiles = table(spark, sf, "part").filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("brand"), F.lit("labelled_text").alias("strategy"), F.lit(1).alias("hits"), F.lit(0).alias("misses"), F.lit("x").alias("last_ok")).distinct()
    return runs.charges_run(p.join(cat, "page_id"), profiles)["summary"]


from . import more_queries, stream_queries, traffic_queries  # noqa: E402, F401
