"""Exact medians of groups of any size.

Where no group has more than LIMIT values, Spark's own median does it: its buffer holds one group's values.  Otherwise the two middle
places of all groups are found at once by narrowing: a place lies in a range of values that holds a known number of values below it; each round cuts
every range that still has more than LIMIT values into BINS bins and counts them (partial counts, so a group is never in one task), and
the bin that the place falls in, with its own least and greatest value, is the next range.  Rounds cut by the logarithm and by the value in turn: the
first ends long tails, the second what is left.  A range of one value is an answer; the values of ranges of LIMIT or fewer are gathered.
The values themselves are read once a round and are not shuffled.

Values are finite; nulls are left out, and a group of nulls alone has a null median and n = 0; null keys are a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import stored

LIMIT, BINS = 100_000, 2048


def medians(df: DataFrame, by: list[str], value: str | Column, limit: int = LIMIT) -> DataFrame:
    """by..., m (median), n (values that are not null): a row for each group; without by one row."""
    v = F.col(value) if isinstance(value, str) else value
    rows = stored(df.select(*by, v.cast("double").alias("__v")), "values")
    counts = (rows.groupBy(*by) if by else rows).agg(F.count("__v").alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= limit:
        return (rows.groupBy(*by) if by else rows).agg(F.median("__v").alias("m"), F.count("__v").alias("n"))
    return _by_narrowing(rows, by, limit)


def _joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns by equal keys, nulls being equal.  Spark broadcasts right while it is small."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one group: two rows at most
    r = right.withColumnsRenamed({c: f"__r_{c}" for c in by})
    return left.join(r, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by)), how).drop(*(f"__r_{c}" for c in by))


def _bin(flat: bool) -> Column:
    """The bin of __v in lo .. hi; it does not fall where __v rises."""
    g = (lambda c: F.col(c) / 2) if flat else (lambda c: F.signum(c) * F.log1p(F.abs(F.col(c))))
    at = F.coalesce(F.try_divide(g("__v") - g("lo"), g("hi") - g("lo")), F.lit(0.0))
    return F.least(F.greatest(F.floor(at * BINS), F.lit(0)), F.lit(BINS - 1))


def _by_narrowing(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    own = rows.filter("__v IS NOT NULL")
    sizes = stored((rows.groupBy(*by) if by else rows).agg(F.count("__v").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")), "sizes")
    places = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    columns = [*by, "k", "lo", "hi", "below", "inside"]
    todo = sizes.filter("n > 0").select(*by, F.explode(places).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    todo, flat = stored(todo, "places"), False
    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > limit)
    while not todo.filter(wide).isEmpty():
        found = _joined(own, todo.filter(wide).drop("inside"), by).filter(F.col("__v").between(F.col("lo"), F.col("hi")))
        bins = found.groupBy(*by, "k", "below", _bin(flat).alias("bin")).agg(F.count("*").alias("inside"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        before = F.coalesce(F.sum("inside").over(Window.partitionBy(*by, "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of BINS rows at most
        bins = bins.withColumn("below", F.col("below") + before).filter((F.col("below") <= F.col("k")) & (F.col("k") < F.col("below") + F.col("inside")))
        todo, flat = stored(todo.filter(~wide).select(columns).unionByName(bins.select(columns)), "places"), not flat
    sure = todo.filter("lo = hi").select(*by, F.col("lo").alias("x"))
    rest = _joined(own, todo.filter("lo < hi"), by).filter(F.col("__v").between(F.col("lo"), F.col("hi")))
    rest = rest.groupBy(*by, "k", "below").agg(F.sort_array(F.collect_list("__v")).alias("v")).select(*by, F.get("v", F.col("k") - F.col("below")).alias("x"))  # LIMIT values at most
    mid = sure.unionByName(rest)
    mid = (mid.groupBy(*by) if by else mid).agg(F.sum(F.col("x") * 0.5).alias("half"), F.count("*").alias("places"))
    out = _joined(sizes.select(*by, "n"), mid, by, "left")
    return out.select(*by, (F.col("half") * 2 / F.col("places")).alias("m"), "n")
