"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each document gets counts over its whole text, and from them a vector of transformed statistics.
Per (lang, source) a minimum-covariance-determinant estimate is fitted by concentration steps: the half
of the documents nearest by Mahalanobis distance gives the next mean and covariance, whose determinant cannot grow.
Three starts (quartile ranges, spatial signs, squashed scores, all about the medians) take EARLY steps each; the one of
the least determinant goes on until no group's determinant falls any more, and a reweighted estimate ends it.
A document whose squared distance exceeds its group's cutoff is rejected: a chi-square quantile, widened by the group's
median distance where that is above the chi-square median.  Only DataFrame functions are used; estimates are one row per
group, quantiles come from counts of bins by group and bin (of x by X_BIN, of the logarithm of a distance by D_BIN, so a
cut is at most that much beyond the quantile), and moments from partial sums, so a hot group never meets in one task.

Counts, with words = runs of ``[^\\x20\\x09-\\x0D]``: word_chars (code points in words), n_symbols
(characters of ``#*$%&|<>``), n_dup_lines (lines that hold a word and equal an earlier line),
n_repeat_words (words in 5-word windows found twice or more in the text).  Windows are compared by
64-bit hashes of 64-bit word hashes.

Defined cases: a null text counts as empty (no words, base_failed).  Null lang or source is a group
of its own.  A group of fewer than min_docs documents that pass the base rules is pooled with the
other such groups of its language, and what is still too small with the rest of the corpus; without
any passing document nothing is kept.  A variance below its floor is raised to the floor, so constant
statistics and repeated rows (ties) give no singular matrix; the same holds for what of a variance the statistics before it leave.  An
empty table gives an empty result; texts of any length are counted whole.  A distance equal to the cutoff keeps the document.
Repeated rows get equal verdicts.  Extra columns pass through unread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, packed, small, stored, words

#: Name, standard deviation that counts as none (transformed units).
FEATURES = {"word_len": 0.08, "symbols": 0.08, "dup_lines": 0.10, "repeats": 0.08, "upper": 0.05, "marks": 0.05}
HALF = 0.5
#: Steps of each start; steps at most after them (the determinant stops falling sooner), and what counts as falling.
EARLY, MAX_STEPS, FALL = 2, 40, 1e-4
#: Width of the bins of quantiles: of statistics, and of logarithms of squared distances.
X_BIN, D_BIN = 0.001, 0.001
MIN_DOCS = 200
#: Squared distance beyond which a document goes: the 0.99999 quantile of chi-square with six degrees of freedom.
CUTOFF = 33.107
#: Median and 0.975 quantile of chi-square with six degrees of freedom: fixed values.
MEDIAN_CHI2, REWEIGHT_CHI2 = 5.348, 14.449
MAX_BROADCAST_GROUPS = 20_000


def _count(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and the counts in columns that begin with ``__``: nw, wc, sym, dup, rep, up, mark, lines."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__w", words(t)).withColumn("__ls", F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}")))
    out = out.withColumns({
        "__nw": F.size("__w").cast("long"), "__wc": F.length(F.array_join("__w", "")).cast("long"), "__lines": F.size("__ls").cast("long"),
        "__dup": (F.size("__ls") - F.size(F.array_distinct("__ls"))).cast("long"), "__sym": _count(t, "#*$%&|<>"),
        "__up": _count(t, r"\p{Lu}"), "__mark": _count(t, "!?.,;:"), "__wh": F.transform("__w", lambda x: F.xxhash64(x)),
    })
    # each word hash is read five times, which keeps the optimizer from moving its making into the lambda
    window = lambda i: F.xxhash64(*(F.get(F.col("__wh"), i + k) for k in range(5)))
    none = F.array().cast("array<bigint>")
    out = out.withColumn("__win", F.when(F.col("__nw") >= 5, F.transform(F.sequence(F.lit(0), F.col("__nw").cast("int") - 5), window)).otherwise(none))
    twice = F.size("__win") > F.size(F.array_distinct("__win"))
    pairs = F.array_sort(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__by", F.when(twice, pairs))
    at = lambda i: F.get(F.col("__by"), i)
    same = lambda i, j: F.coalesce(at(i)["h"] == at(j)["h"], F.lit(False))
    found = F.filter(F.sequence(F.lit(0), F.size("__by") - 1), lambda i: same(i, i - 1) | same(i, i + 1))
    places = F.array_sort(F.transform(found, lambda i: at(i)["i"]))
    fold = F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + 5).alias("end"), (a["n"] + p + 5 - F.greatest(p, a["end"])).alias("n")),
    )
    out = out.withColumn("__rep", F.when(F.col("__by").isNotNull(), fold["n"]).otherwise(F.lit(0)).cast("long"))
    return out.drop("__w", "__ls", "__wh", "__win", "__by")


def base_failed() -> Column:
    return (F.col("__nw") < 10) | (100 * F.col("__rep") > 20 * F.col("__nw"))


def features() -> list[Column]:
    """The transformed statistics.  Counts are shrunk towards usual values in short texts, whose ratios say little."""
    nw, share = F.col("__nw"), lambda c, n, add: F.sqrt(F.col(c) / (F.col(n) + F.lit(float(add))))
    return [
        F.log((F.col("__wc") + 100.0) / (nw + 20.0)), share("__sym", "__nw", 50), share("__dup", "__lines", 5),
        share("__rep", "__nw", 50), F.sqrt((F.col("__up") + 4.0) / (F.col("__wc") + 200.0)), F.sqrt((F.col("__mark") + 4.0) / (nw + 40.0)),
    ]


def _names() -> list[str]:
    return [f"x{i}" for i in range(len(FEATURES))]


def _cholesky(df: DataFrame) -> DataFrame:
    """From means m_i and covariances c_i_j of each group, the lower factor l_i_j, a column at a time."""
    p, floors = len(FEATURES), list(FEATURES.values())
    for j in range(p):
        for i in range(j, p):
            cov = F.coalesce(F.col(f"c_{i}_{j}"), F.lit(0.0))
            rest = cov - reduce(lambda a, k: a + F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.lit(0.0))
            df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(floors[i] ** 2))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return df


def _factor(est: DataFrame) -> DataFrame:
    """g, start; means and factor as a struct, so that each step carries one column; the logarithm of the determinant."""
    p = len(FEATURES)
    est = _cholesky(est)
    fields = [F.col(f"m_{i}").alias(f"m{i}") for i in range(p)] + [F.col(f"l_{i}_{j}").alias(f"l{i}_{j}") for i in range(p) for j in range(i + 1)]
    det = reduce(lambda a, i: a + 2 * F.log(f"l_{i}_{i}"), range(p), F.lit(0.0))
    return est.select("g", "start", F.struct(*fields).alias("est"), det.alias("det"))


def _distance(df: DataFrame) -> DataFrame:
    """d2 by forward substitution, one column after another."""
    for i in range(len(FEATURES)):
        rest = F.col(f"x{i}") - F.col(f"est.m{i}") - reduce(lambda a, k: a + F.col(f"est.l{i}_{k}") * F.col(f"y{k}"), range(i), F.lit(0.0))
        df = df.withColumn(f"y{i}", rest / F.col(f"est.l{i}_{i}"))
    total = reduce(lambda a, b: a + b, (F.col(f"y{i}") * F.col(f"y{i}") for i in range(len(FEATURES))))
    return df.withColumn("d2", total).drop(*(f"y{i}" for i in range(len(FEATURES))))


def _moments(df: DataFrame, values: list[Column] | None = None) -> DataFrame:
    """Means m_i and covariances c_i_j of each group and start, from sums."""
    p, x = len(FEATURES), values or [F.col(n) for n in _names()]
    sums = [F.sum(x[i]).alias(f"s_{i}") for i in range(p)] + [F.sum(x[i] * x[j]).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)]
    out = df.groupBy("g", "start").agg(F.count("*").alias("n"), *sums)
    means = [(F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in range(p)]
    cov = [(F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"s_{i}") / F.col("n") * F.col(f"s_{j}") / F.col("n")).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)]
    return out.select("g", "start", *means, *cov)


def _per_group(df: DataFrame, table: DataFrame, few: bool, on: list[str]) -> DataFrame:
    """Join by group; broadcast only when the number of groups was counted and is small."""
    return df.join(F.broadcast(table) if few else table, on, "left")


def _quantiles(df: DataFrame, by: list[str], bin_: Column, shares: list[float]) -> DataFrame:
    """For each group the numbers of the bins that hold these quantiles, as an array b."""
    counts = df.groupBy(*by, bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    upto = counts.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    return upto.groupBy(*by).agg(F.array(*(F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin"))) for share in shares)).alias("b"))


def _cuts(near: DataFrame, share: float) -> DataFrame:
    """g, start, cut: the distance that this share of a group does not exceed."""
    found = _quantiles(near, ["g", "start"], F.floor(F.log(F.greatest("d2", F.lit(1e-12))) / D_BIN), [share])
    return found.select("g", "start", F.exp((F.col("b")[0] + 1) * F.lit(D_BIN)).alias("cut"))


def starts(vectors: DataFrame, few: bool) -> DataFrame:
    """Three estimates of each group: g, start, est, det."""
    p = len(FEATURES)
    each = vectors.select("g", F.posexplode(F.array(*_names())).alias("i", "x"))
    found = _quantiles(each, ["g", "i"], F.floor(F.col("x") / X_BIN), [0.25, 0.5, 0.75])
    spread = F.greatest((F.col("b")[2] - F.col("b")[0]) * X_BIN / 1.349, F.element_at(F.array(*map(F.lit, FEATURES.values())), F.col("i") + 1))
    found = found.select("g", "i", ((F.col("b")[1] + 0.5) * X_BIN).alias("mid"), spread.alias("spread"))
    box = found.groupBy("g").agg(*(F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in range(p) for c in ("mid", "spread")))
    box = stored(box, "box")
    plain = box.select("g", F.lit(0).alias("start"), *(F.col(f"mid{i}").alias(f"m_{i}") for i in range(p)), *((F.col(f"spread{i}") ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)))
    # scores about the medians: their directions, and squashed
    both = _per_group(vectors, box, few, ["g"])
    z = [(F.col(f"x{i}") - F.col(f"mid{i}")) / F.col(f"spread{i}") for i in range(p)]
    both = both.select("g", *(z[i].alias(f"z{i}") for i in range(p)))
    length = F.greatest(F.sqrt(reduce(lambda a, i: a + F.col(f"z{i}") * F.col(f"z{i}"), range(p), F.lit(0.0))), F.lit(1e-9))
    both = both.withColumn("length", length).withColumn("start", F.explode(F.array(F.lit(1), F.lit(2))))
    scores = [F.when(F.col("start") == 1, F.col(f"z{i}") / F.col("length")).otherwise(F.tanh(f"z{i}")) for i in range(p)]
    shape = _per_group(_moments(both, values=scores), box, few, ["g"])
    # correlations of the scores, with the quartile ranges as deviations
    deviation = [F.sqrt(F.greatest(F.col(f"c_{i}_{i}"), F.lit(1e-9))) for i in range(p)]
    cov = [(F.col(f"c_{i}_{j}") / deviation[i] / deviation[j] * F.col(f"spread{i}") * F.col(f"spread{j}")).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)]
    shape = shape.select("g", "start", *(F.col(f"mid{i}").alias(f"m_{i}") for i in range(p)), *cov)
    return stored(_factor(plain.unionByName(shape)), "mcd-starts")


def _step(vectors: DataFrame, est: DataFrame, few: bool, half: float) -> DataFrame:
    """The estimates of the half that is nearest by the last ones."""
    near = _distance(_per_group(vectors, est, few, ["g"]))
    within = _per_group(near, _cuts(near, half), few, ["g", "start"]).filter(F.col("d2") <= F.col("cut"))
    return stored(_factor(_moments(within)), "mcd")


def least_determinants(vectors: DataFrame, few: bool, half: float = HALF) -> DataFrame:
    """vectors: g and x0..; the estimate of the least determinant of each group: g, start, est, det."""
    est = starts(vectors, few)
    for _ in range(EARLY):
        est = _step(vectors, est, few, half)
    best = est.groupBy("g").agg(F.min_by(F.struct("start", "est", "det"), F.struct("det", "start")).alias("e")).select("g", "e.*")
    best = stored(best, "mcd-best")
    for _ in range(MAX_STEPS):
        new = _step(vectors, best, few, half)
        # a step never makes it worse but for the width of a bin: the lesser one stays
        both = best.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
        kept = both.groupBy("g").agg(F.min_by(F.struct("start", "est", "det"), F.struct("det", "new")).alias("e"), (F.max(F.when(F.col("new") == 0, F.col("det"))) - F.min("det")).alias("fall"))
        kept = stored(kept.select("g", "e.*", "fall"), "mcd-best")
        best = kept.drop("fall")
        if (kept.agg(F.max("fall")).first()[0] or 0) <= FALL:
            break
    return best


def estimates(vectors: DataFrame, few: bool, half: float = HALF) -> DataFrame:
    """vectors: g and x0..; one row for each g: est, reweighted."""
    est = least_determinants(vectors, few, half)
    # make the half's covariance consistent by the median distance, then reweight
    near = _distance(_per_group(vectors, est, few, ["g"]))
    mid = _cuts(near, 0.5)
    scale = F.greatest(F.lit(1.0), F.col("cut") / MEDIAN_CHI2)
    within = _per_group(near, mid, few, ["g", "start"]).filter(F.col("d2") / scale <= REWEIGHT_CHI2)
    return stored(_factor(_moments(within)).select("g", "start", "est"), "mcd-end")


def grouped(counts: DataFrame, min_docs: int) -> DataFrame:
    """counts: lang, source, n (documents that pass the base rules); adds g, the group whose estimate is used."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("__lang", "__source"))
    own = F.col("__n") >= min_docs
    counts = counts.withColumn("__own", own)
    pool = counts.filter(~own).groupBy("__lang").agg((F.sum("__n") >= min_docs).alias("__pool"))
    same = F.col("a.__lang").eqNullSafe(F.col("b.__lang"))
    out = counts.alias("a").join(pool.alias("b"), same, "left").select("a.*", "b.__pool")
    g = F.when(F.col("__own"), F.to_json(F.array(lang, source))).when(F.col("__pool"), F.to_json(F.array(lang))).otherwise(F.lit("[]"))
    return out.select("__lang", "__source", g.alias("g"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", columns: list[str] | None = None, min_docs: int = MIN_DOCS, cutoff: float = CUTOFF) -> DataFrame:
    """docs' columns (or those named) as ``__row``, the counts, ``base_failed``, ``d2`` and ``kept``."""
    rows = packed(docs, __text=text, __lang=lang, __source=source)
    row = F.col("__row") if columns is None else F.struct(*(F.col(f"__row.`{c}`") for c in columns)) if columns else F.lit(None).cast("struct<a:int>")
    vectors = dict(zip(_names(), features(), strict=True))
    counted = statistics(rows, "__text").withColumns(vectors).withColumn("__fail", base_failed())
    keep = ["__nw", "__wc", "__sym", "__dup", "__rep", "__fail", "__lang", "__source", *_names()]
    table = stored(counted.select(row.alias("__row"), *keep), "rules")
    counts = table.groupBy("__lang", "__source").agg(F.count_if(~F.col("__fail")).alias("__n"))
    groups = stored(grouped(counts, min_docs), "groups")
    few = small(groups, MAX_BROADCAST_GROUPS)
    # groups by number, so that the passes over the vectors carry and compare little
    groups = stored(groups.withColumn("g", F.dense_rank().over(Window.orderBy("g"))) if few else groups, "groups")
    a, b = table.alias("a"), (F.broadcast(groups) if few else groups).alias("b")
    on = F.col("a.__lang").eqNullSafe(F.col("b.__lang")) & F.col("a.__source").eqNullSafe(F.col("b.__source"))
    table = a.join(b, on, "left").select("a.*", "b.g")
    vectors = stored(table.filter(~F.col("__fail")).select("g", *_names()), "vectors")
    est = estimates(vectors, few)
    near = _distance(_per_group(vectors, est, few, ["g"]))
    cuts = _cuts(near, 0.5).select("g", "start", (cutoff * F.greatest(F.lit(1.0), F.col("cut") / MEDIAN_CHI2)).alias("cut"))
    out = _distance(_per_group(table, stored(est.join(cuts, ["g", "start"]), "cuts"), few, ["g"]))
    return out.withColumn("__kept", ~F.col("__fail") & F.coalesce(F.col("d2") <= F.col("cut"), F.lit(False)))


def quality_rules(docs: DataFrame, **how) -> DataFrame:
    """The documents that pass, with docs' own columns."""
    return judge(docs, **how).filter("__kept").select("__row.*")
