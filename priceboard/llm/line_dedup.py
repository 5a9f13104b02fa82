"""Cross-site boilerplate lines by distinct-site spread.

Every line is hashed; per hash a HyperLogLog sketch of the sites that show it is merged by
aggregation.  Estimates well above or below SITES decide; lines whose estimate is near it get an exact
distinct count.  Lines shown by SITES sites or more leave every document.

A line counts as its words joined by one space.  Lines of fewer than WORDS words recur by chance sooner, so they need
SITES_SHORT sites.  Equality of lines is equality of 64-bit hashes.

Defined cases: a null text stays null and has no lines; empty lines stay; a null site is a site of its
own; repeated rows show a line at one site once; a line shown by exactly SITES sites (a tie) goes; texts of any length are
split whole, and a text of many removed lines costs no more than its lines; an empty table gives an empty result; other columns
pass through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, packed, stored

SITES, SITES_SHORT = 5, 10
WORDS = 4
LG_K = 10
#: Four standard errors of a sketch with 2**10 registers, and one site more.
BAND = 4 * 1.04 / 2 ** (LG_K / 2)


def _rows(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    rows = packed(docs, __id=key, __text=text, __site=site)
    return rows.withColumns({
        "__key": F.concat_ws("/", F.col("__id").cast("string"), F.md5(F.coalesce(F.col("__text"), F.lit("")).cast("binary"))),
        "__site": F.coalesce(F.concat(F.lit("="), F.col("__site").cast("string")), F.lit("null")),
    })


def lines(rows: DataFrame) -> DataFrame:
    """__key, __site, at (0, 1, ... in the text), h, short."""
    one = rows.select("__key", "__site", F.posexplode(F.split("__text", "\n")).alias("at", "line"))
    plain = F.regexp_replace(F.btrim("line", F.lit(SPACE_CHARS)), SPACE + "+", " ")
    one = one.withColumn("plain", plain)
    short = F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) < WORDS - 1
    return one.filter("plain <> ''").select("__key", "__site", "at", F.xxhash64("plain").alias("h"), short.alias("short"))


def boilerplate(found: DataFrame, sites: int = SITES, sites_short: int = SITES_SHORT) -> DataFrame:
    """h of the lines shown by that many sites or more."""
    need = F.when(F.col("short"), sites_short).otherwise(sites)
    spread = found.groupBy("h", "short").agg(F.hll_sketch_estimate(F.hll_sketch_agg("__site", F.lit(LG_K))).alias("n"))
    spread = stored(spread.filter(F.col("n") >= need * (1 - BAND) - 1), "spread")
    sure = F.col("n") > need * (1 + BAND) + 1
    exact = found.join(spread.filter(~sure).select("h"), "h").groupBy("h", "short", "__site").count().groupBy("h", "short").count()
    return spread.filter(sure).select("h").union(exact.filter(F.col("count") >= need).select("h"))


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES, sites_short: int = SITES_SHORT) -> DataFrame:
    """__row, __id, __text (without boilerplate lines), n_lines, n_removed."""
    rows = _rows(docs, key, text, site)
    found = stored(lines(rows), "lines")
    bad = stored(boilerplate(found, sites, sites_short), "boilerplate")
    marked = found.join(bad, "h", "left_semi").groupBy("__key").agg(F.collect_set("at").alias("__out"))
    # read more than once below, which keeps the optimizer from splitting the text anew for each line
    joined = rows.join(marked, "__key", "left").withColumn("__parts", F.split("__text", "\n"))
    parts = F.col("__parts")
    # positions that stay: a hashed set difference, so a text of many removed lines costs no more than its lines
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__out")
    kept = F.when(F.col("__out").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    return joined.select(
        "__row", "__id", kept.alias("__text"), F.coalesce(F.size(parts), F.lit(0)).alias("__lines"), F.coalesce(F.size("__out"), F.lit(0)).alias("__removed")
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES, sites_short: int = SITES_SHORT) -> DataFrame:
    """docs with the lines taken out."""
    done = cleaned(docs, key, text, site, sites, sites_short)
    return done.select(*(F.col("__text").alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))


#: The same for DuckDB.
SQL = f"""
WITH l AS (
  SELECT doc_id, source, pos, trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS plain, line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), b AS (
  SELECT plain FROM l WHERE plain <> ''
  GROUP BY plain HAVING count(DISTINCT coalesce('=' || source, 'null')) >= CASE WHEN len(string_split(plain, ' ')) < {WORDS} THEN {SITES_SHORT} ELSE {SITES} END
), k AS (SELECT l.*, b.plain IS NOT NULL AS gone FROM l LEFT JOIN b USING (plain))
SELECT d.doc_id, count(k.pos)::INT AS n_lines, count_if(k.gone)::INT AS n_removed,
       md5(coalesce(string_agg(CASE WHEN NOT k.gone THEN k.line END, chr(10) ORDER BY k.pos), '')) AS text_md5
FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
"""
