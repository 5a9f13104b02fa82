import hashlib
import random
from collections import defaultdict

import pytest

from priceboard.llm import exact_dedup as ed


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1] or ""].append(r[0])
    out = []
    for text, ids in by.items():
        top = max((i for i in ids if i is not None), default=None)
        sha, first = hashlib.sha256(text.encode()).hexdigest(), True
        for i in ids:
            out.append((i, top, len(ids), i == top and first, sha))
            first = first and i != top
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"], r["sha"]) for r in df.collect()), key=str)


def corpus(n, seed, hot=0):
    rng = random.Random(seed)
    texts = ["t" * (i % 9) + f" {rng.randrange(n // 3)} é" for i in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(n + i, "the hot text " * 40) for i in range(hot)]


@pytest.mark.parametrize("bits, capacity, depth", [(64, ed.CAPACITY, 20), (64, 1500, 20), (6, 1500, 20), (2, 1500, 20), (0, 4000, 20), (64, 1500, 3)])
def test_against_brute_force(make, monkeypatch, bits, capacity, depth):
    """With few bits many texts share a key, so chains hold different texts and buckets overflow."""
    monkeypatch.setattr(ed, "LEAST_CAPACITY", 1000)
    rows = corpus(300, 5, hot=200) + [(None, None), (7, ""), (None, "the hot text " * 40), (4, "ties"), (4, "ties"), (4, "ties"), (None, "n"), (None, "n")]
    got = ed.groups(ed.build(make(rows), capacity=capacity, bits=bits, max_depth=depth))
    assert rows_of(got) == brute(rows)


def test_bucket_of_a_hot_key_gets_pages_that_meet_again(make, monkeypatch):
    monkeypatch.setattr(ed, "LEAST_CAPACITY", 1000)
    monkeypatch.setattr(ed, "FAN_IN", 3)
    rows = corpus(100, 6, hot=400)
    index = ed.build(make(rows), capacity=2000)
    assert index.directory.agg({"pages": "max"}).first()[0] > 9 and rows_of(ed.groups(index)) == brute(rows)
    assert [r["n"] for r in index.entries.filter("n > 100").collect()] == [400]


def test_directory(make):
    chains = make([(h << 52, f"{n}") for h, n in ((0, 10), (1, 10), (2, 90), (5, 300), (-1, 50), (-2048, 60))]).selectExpr("doc_id AS h", "cast(text AS long) AS size")
    buckets, depth = ed.grow(chains, 100)
    assert depth == max(b.depth for b in buckets) and sum(b.size for b in buckets) == 520
    assert all(b.size <= 100 or b.pages == 3 for b in buckets)
    table, owners = ed.pointers(buckets, depth, 100)
    assert len({p for p, *_ in table}) == len(table) and owners >= 6
    for h in (0, 1, 2, 5, -1, -2048):  # every key has a pointer to the bucket of its leading bits
        p = ((h << 52) & (2**64 - 1)) >> (64 - depth)
        (row,) = [t for t in table if t[0] == p]
        b = buckets[row[1]]
        assert p >> (depth - b.depth) == b.prefix
    assert ed.grow(chains.filter("h > 1e30"), 100) == ([], 0)


def test_kept_rows(spark, make):
    rows = [(1, "a", "en", "s", 1), (2, "a", "en", "s", 2), (2, "a", "de", "s", 3), (3, None, None, None, 4), (5, "", None, None, 5), (6, "alone", None, None, None), (None, "x", None, None, 1), (None, "x", None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __h string, `pages.x` int")
    got = ed.deduplicate(docs).collect()
    assert ed.deduplicate(docs).columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"]) == [(2, "a"), (5, ""), (6, "alone")] and len(got) == 4
    assert sorted(r["doc_id"] or 0 for r in ed.deduplicate(docs, bits=0).collect()) == [0, 2, 5, 6]


def test_empty_and_very_long(make):
    empty = ed.build(make([]))
    assert ed.groups(empty).collect() == [] and ed.deduplicate(make([])).collect() == []
    long = "word " * 400_000
    rows = [(1, long), (2, long), (3, long + "x"), (4, long[:-1])]
    assert rows_of(ed.groups(ed.build(make(rows)))) == brute(rows)


def test_same_digest_is_an_error(make, monkeypatch):
    monkeypatch.setattr(ed.hashlib, "sha256", lambda t: hashlib.md5(b""))
    run = ed._chained(False)
    import pyarrow as pa

    cols = {"h": [1, 1], "bucket": [0, 0], "pages": [1, 1], "text": [b"a", b"b"], "top": [1, 2], "n_top": [1, 1], "n": [1, 1]}
    with pytest.raises(ValueError, match="same SHA-256"):
        list(run([pa.RecordBatch.from_pydict(cols)]))
