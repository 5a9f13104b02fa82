"""Sources: tables, saved pages, sitemaps, feeds and JSON documents as DataFrames."""

from __future__ import annotations

import os
import re
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.tables import spread

#: Parts of a sitemap's path that keep it from being followed, and one that it needs.
SKIP_INDEX, NEED_INDEX = r"(?i)page|collection|blog|author|news", r"(?i)product|sitemap"
RATE_API = {"24K": "Rate24K", "22K": "Rate22K", "18K": "Rate18K", "14K": "Rate14K"}
PROFILE = "brand string, strategy string, hits int, misses int, last_ok string"
CHARGES = "array<struct<brand:string,categories:array<struct<category:string,items:bigint,making_pct_median:double,making_pct_min:double,making_pct_max:double,confidence:string,rejected_outliers:bigint,examples:array<struct<url:string,pct:double>>>>>>"


def read_brands(spark: SparkSession, path: str, active: bool | None = True, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df if active is None else df.filter(F.col("active") == active)
    return df.select(*columns) if columns else df


def read_rates(spark: SparkSession, path: str, day: str | None = None, since: str | None = None, status: str | None = None, brands: DataFrame | None = None) -> DataFrame:
    """Partitioned by rate_date, so day and since prune partitions."""
    df = spark.read.parquet(path)
    if day is not None:
        df = df.filter(F.col("rate_date") == F.lit(day).cast("date"))
    if since is not None:
        df = df.filter(F.col("rate_date") >= F.lit(since).cast("date"))
    if status is not None:
        df = df.filter(F.col("status") == status)
    return df if brands is None else df.join(brands, "brand_id")


def read_subscribers(spark: SparkSession, path: str, columns=("id", "name", "email", "unsub_token", "last_emailed")) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def with_day(log: DataFrame, ts: str = "created_at") -> DataFrame:
    return log.withColumn("day", S.local_day(F.col(ts)))


def read_log(spark: SparkSession, path: str, stream: bool = False, schema=None) -> DataFrame:
    """Page views or clicks, batch or stream, with the local day."""
    return with_day((spark.readStream.schema(schema) if stream else spark.read).parquet(path))


def read_pages(df: DataFrame, min_len: int = 500) -> DataFrame:
    """df: url, brand, html, source and status.  Error pages and stubs go."""
    ok = F.coalesce(F.col("status"), F.lit(200)) == 200 if "status" in df.columns else F.lit(True)
    return df.filter(ok & (F.length("html") > min_len))


#: What is read of a sitemap, whichever of the two documents it is; and of a feed.
SITEMAP = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>"
FEED = "channel struct<item:array<struct<title:string,link:string,source:struct<_VALUE:string,_url:string>,pubDate:string>>>"
LENIENT = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
#: The folder of pages without a name, as Spark's writers call it.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
#: How many times as many tasks as a shuffle has read an archive at most.
TASKS = 8


def locs(xml: Column) -> Column:
    """The locations of a sitemap or an index of sitemaps: namespaces, CDATA, attributes and entities are XML's.  Text that is no such document is searched for loc elements."""
    doc = F.from_xml(F.trim(xml), SITEMAP, LENIENT)
    parsed = F.transform(F.concat(F.coalesce(doc["url"], F.array().cast("array<struct<loc:string>>")), F.coalesce(doc["sitemap"], F.array().cast("array<struct<loc:string>>"))), lambda u: F.trim(u["loc"]))
    searched = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1)), S.html_unescape)
    found = F.filter(parsed, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(found) > 0, F.transform(found, S.html_unescape)).otherwise(searched)


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """loc, lastmod, changefreq, priority of the url elements of sitemap files."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod date, changefreq string, priority double").load(path)


def read_sitemaps(files: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """files: url, body of saved sitemaps; roots: url.  Page URLs of the roots and of nested index files, followed depth times."""
    entries = files.filter(F.length("body") > 120).select("url", F.explode(F.array_distinct(locs(F.col("body")))).alias("loc"))
    path = F.coalesce(F.try_parse_url("loc", F.lit("PATH")), F.col("loc"))
    nested = path.endswith(".xml") & ~path.rlike(SKIP_INDEX) & path.rlike(NEED_INDEX)
    level, out = roots.select("url").distinct(), None
    for _ in range(depth + 1):
        found = entries.join(level, "url", "left_semi")
        pages = found.filter(~path.endswith(".xml")).select("loc")
        out = pages if out is None else out.unionByName(pages)
        level = found.filter(nested).select(F.col("loc").alias("url")).distinct()
    return out.distinct()


def read_catalog_json(df: DataFrame) -> DataFrame:
    """df: origin, body.  products[] as url, title, product_type."""
    kind = "struct<products:array<struct<title:string,handle:string,product_type:string>>>"
    p = df.select("origin", F.explode(F.from_json("body", kind)["products"]).alias("p"))
    return p.select(F.concat("origin", F.lit("/products/"), "p.handle").alias("url"), "p.title", "p.product_type")


def read_rate_api_json(df: DataFrame, fields: dict[str, str] = RATE_API) -> DataFrame:
    """df: page_id, body.  Four fields as rows of purity and value; the inner Status must be 200."""
    kind = "struct<Status:int," + ",".join(f"{f}:string" for f in fields.values()) + ">"
    r = df.select("page_id", F.from_json("body", kind).alias("r")).filter("r.Status = 200").select("page_id", *(S.parse_amount(F.col(f"r.{f}")).alias(k) for k, f in fields.items()))
    return r.unpivot("page_id", list(fields), "purity", "value").filter("value is not null")


def read_news_rss(df: DataFrame) -> DataFrame:
    """df: body of saved feeds, and feed (their order; 0 where it is missing).  feed, place (in the feed), title, link, source, published.  A feed that is no XML document
    is searched for item elements."""
    if "feed" not in df.columns:
        df = df.withColumn("feed", F.lit(0))

    def text(i, t):
        own = F.regexp_extract(i, rf"(?is)<{t}[^>]*>\s*(.*?)\s*</{t}>", 1)
        plain = F.regexp_extract(own, r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)
        return F.when(own.startswith("<![CDATA["), plain).otherwise(S.html_unescape(own))

    row = lambda title, link, source, day: F.struct(title.alias("title"), link.alias("link"), source.alias("source"), day.alias("day"))
    parsed = F.transform(F.from_xml(F.trim("body"), FEED, LENIENT)["channel"]["item"], lambda i: row(i["title"], i["link"], i["source"]["_VALUE"], i["pubDate"]))
    searched = F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<item>(.*?)</item>"), F.lit(1)), lambda i: row(*(text(i, t) for t in ("title", "link", "source", "pubDate"))))
    items = df.select("feed", F.posexplode(F.coalesce(parsed, searched)).alias("place", "i"))
    return items.select("feed", "place", *(S.clean_text(F.col(f"i.{c}")).alias(c) for c in ("title", "link", "source")), S.pub_date(S.clean_text(F.col("i.day"))).alias("published"))


def read_benchmarks(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """pages: name, html; patterns: name, purity, pattern (one group), low, high, grams.  Per-gram value of each pattern inside its gate."""
    j = pages.join(patterns, "name").withColumn("__t", S.visible_text(F.col("html")))
    v = S.parse_amount(F.expr("regexp_extract(__t, pattern, 1)"))
    return j.select("name", "purity", v.alias("quoted"), "grams", "low", "high").filter(F.col("quoted").between(F.col("low"), F.col("high"))).select("name", "purity", (F.col("quoted") / F.col("grams")).alias("value"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Empty when the file is missing; broken rows are left out."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(PROFILE).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], PROFILE)


def flat_charges(docs: DataFrame) -> DataFrame:
    """docs: body, a JSON list of brands with categories.  A row per brand and category."""
    b = docs.select(F.explode(F.from_json("body", CHARGES)).alias("b")).select("b.brand", F.explode("b.categories").alias("c"))
    return b.select("brand", "c.*")


def read_making_charges(spark: SparkSession, path: str) -> DataFrame:
    return flat_charges(spark.read.text(path, wholetext=True).withColumnRenamed("value", "body"))


def read_search_rows(df: DataFrame, key: str) -> DataFrame:
    """df: keys (array), clicks, impressions, ctr, position."""
    return df.select(F.try_element_at("keys", F.lit(1)).alias(key), "clicks", "impressions", "ctr", "position")


def _unquoted(c: Column) -> Column:
    """%XX as characters; + is itself."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def read_page_archive(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages with the date and place of their names: those of the files, or of the folders name=... that a partitioned writer made; and what the file system says of
    each file.  Spark gives a task some 4 to 30 files of any small size, which takes less time than to start it; so there are TASKS times
    as many tasks as a shuffle has at most.  The driver lists the files (900,000 fit a driver of 1,500 MB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    tasks = TASKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = _unquoted(F.col("_metadata.file_path"))
    folder = F.regexp_extract(at, r"/name=([^/]+)/[^/]+$", 1)
    name = F.when(folder != "", F.coalesce(_unquoted(folder), folder)).otherwise(F.regexp_extract(at, r"[^/]*$", 0))
    df = files.select(name.alias("name"), F.decode("content", "UTF-8").alias("html"), F.col("length").alias("bytes"), F.col("modificationTime").alias("saved"))
    return df.select("name", "html", S.date_of_slug(F.col("name")).alias("day"), S.place_of_slug(F.col("name")).alias("place"), "bytes", "saved").coalesce(tasks)


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """Where a path of the local (or mounted) file system is; None for other file systems and relative paths."""
    if path.startswith("/"):
        return path if spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").startswith("file:") else None
    found = re.fullmatch(r"file:(?://[^/]*)?(/.*)", path)
    return found and found[1]


def _saved(root: str):
    """Saves the rows of a task (name, value, digest; equal ones in a row), each as a file below root.  A page's file is named by its text, so a task that is run again
    or twice saves the same files, each of which appears whole."""

    def run(rows):
        task, last, n = TaskContext.get(), None, 0
        for r in rows:
            n, last = n + 1 if (r["name"], r["digest"]) == last else 0, (r["name"], r["digest"])
            folder = f"{root}/name={quote(r['name'] or NO_NAME, safe='')}"
            file = f"part-{task.partitionId():05d}-{r['digest']}-{n}.txt"
            os.makedirs(folder, exist_ok=True)
            hidden = f"{folder}/.{file}.{task.taskAttemptId()}"
            with open(hidden, "wb") as f:
                f.write(r["value"] + b"\n")
            os.replace(hidden, f"{folder}/{file}")

    return run


def write_page_archive(pages: DataFrame, path: str) -> None:
    """pages: name, html.  A folder for each name, with a file for each of its pages, equal ones too.  Pages are dealt to all tasks, and each task puts its own files in
    their places (the driver would move them one by one); so a job that failed may leave pages there, without _SUCCESS.  For a local file Hadoop starts a process that sets
    its mode, and one more for its checksum, which take far longer than a small page; there tasks save the files themselves."""
    rows = pages.select("name", F.coalesce("html", F.lit("")).alias("value"))
    writer = lambda df: df.select("name", "value").write.mode("overwrite").partitionBy("name").option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("lineSep", "\n")
    dealt = spread(rows.withColumn("digest", F.md5("value")), "name", "digest")
    root = _local_folder(pages.sparkSession, path)
    if root is None:
        writer(dealt).option("maxRecordsPerFile", 1).text(path)
        return
    writer(dealt.limit(0)).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").text(path)  # what was there goes
    dealt.select("name", F.col("value").cast("binary").alias("value"), "digest").sortWithinPartitions("name", "digest").foreachPartition(_saved(root))
    open(f"{root}/_SUCCESS", "w").close()
