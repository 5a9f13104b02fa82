"""An archive keeps a file for each page, whatever its name and text, in the local file system and elsewhere."""

import pytest

from priceboard.sources import readers

DAILY = "gold-rate-pune-1-jan-2024.html"
PAGES = [(DAILY, "one"), (DAILY, "two"), (DAILY, "two"), ("gold-rate-navi-mumbai-2-jan-2024.html", "é\nx"), ("p1/a+b 50%.html", None), ("é=.html", "")]
READ = sorted((n, f"{h or ''}\n", len((h or "").encode()) + 1) for n, h in PAGES)


def read(spark, path):
    return sorted((r["name"], r["html"], r["bytes"]) for r in readers.read_page_archive(spark, path).filter("saved IS NOT NULL").collect())


@pytest.mark.parametrize("kind", ["plain", "file", "elsewhere"])
def test_pages_come_back_one_by_one(spark, tmp_path, kind):
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{tmp_path.name}.link./s", f"file://{tmp_path}")
    path = {"plain": f"{tmp_path}/a b%20", "file": f"file://{tmp_path}/a b%20", "elsewhere": f"viewfs://{tmp_path.name}/s/a"}[kind]
    pages = spark.createDataFrame(PAGES, "name string, html string")
    readers.write_page_archive(pages, path)
    assert read(spark, path) == READ
    assert {(r["place"], r["day"].isoformat()) for r in readers.read_page_archive(spark, path).filter("day IS NOT NULL").collect()} == {("Pune", "2024-01-01"), ("Navi Mumbai", "2024-01-02")}
    readers.write_page_archive(pages.limit(0).union(spark.createDataFrame([("n", "new")], "name string, html string")), path)
    assert read(spark, path) == [("n", "new\n", 4)]


def test_a_page_is_one_file(spark, tmp_path):
    """And no other is made for it, for which Hadoop would start a process."""
    readers.write_page_archive(spark.createDataFrame(PAGES, "name string, html string"), f"file://{tmp_path}/a")
    files = [p for p in (tmp_path / "a").rglob("*") if p.is_file()]
    assert len(files) == len(PAGES) + 1 and (tmp_path / "a" / "_SUCCESS") in files


def test_a_task_that_runs_twice_saves_the_same_files(spark, tmp_path):
    rows = spark.createDataFrame([("n", b"x", "d"), ("n", b"x", "d"), ("m", b"y", "e")], "name string, value binary, digest string").coalesce(1)
    for order in (["name"], ["value"]):
        rows.sortWithinPartitions(*order).foreachPartition(readers._saved(str(tmp_path)))
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.txt*")) == ["name=m/part-00000-e-0.txt", "name=n/part-00000-d-0.txt", "name=n/part-00000-d-1.txt"]


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    """Spark would make a task for each file here."""
    readers.write_page_archive(spark.range(300).selectExpr(f"'{DAILY}' AS name", "string(id) AS html"), f"file://{tmp_path}/a")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        got = readers.read_page_archive(spark, f"file://{tmp_path}/a")
        assert got.rdd.getNumPartitions() == 32 and got.select("html").distinct().count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
