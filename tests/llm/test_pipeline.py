import random

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in cp.STAGES[:-1]:
        out = cp.stored(stage(spark, docs, SF), name)
        assert out.columns == columns, name
        if name != "mixing":
            assert 0.5 * n < out.count() <= n and out.select("doc_id").distinct().count() == out.count()
        docs, n = out, out.count()
    last = cp.STAGES[-1][1](spark, docs, SF)
    assert {"slot", "shard"} < set(last.columns) and last.count() == n
    row = lambda r: (r["doc_id"], r["text"], r["shard"])
    assert sorted(map(row, cp.run(spark, SF).collect())) == sorted(map(row, last.collect()))


def test_names():
    assert [k for k, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]


WIDE = "doc_id long, text string, lang string, source string, n_chars long, k long, __row string, shard string"
BENCH = "item_id long, text string"


def write(spark, at, rows, items):
    spark.createDataFrame(rows, WIDE).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, BENCH).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_against_brute_force(spark, prose, tmp_path):
    """Nulls, blanks, copies, ties, a leak and clashing columns: what each stage keeps follows from its rules."""
    rng = random.Random(21)
    item = prose(rng, 20)
    texts = [prose(rng, rng.randint(40, 90)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 2}", len(t), i, "r", "x") for i, t in enumerate(texts)]
    extra = [(100, None), (101, ""), (102, " \n"), (103, "nine words are not enough for it to stay"), (104, texts[0]), (None, texts[1]), (7, texts[7]), (105, f"{prose(rng, 30)}\n{item}\n{prose(rng, 30)}"), (106, prose(rng, 30_000))]
    rows += [(i, t, "en" if i != 104 else None, None if i == 106 else "s0", len(t or ""), 0, None, None) for i, t in extra]
    sf = write(spark, tmp_path, rows, [(1, item)])
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, sf), name)
        seen[name] = docs.collect()
    ids = {k: sorted((r["doc_id"] for r in v), key=str) for k, v in seen.items()}
    assert ids["quality_rules"] == sorted([*range(60), 104, None, 7, 105, 106], key=str)
    assert ids["near_duplicates"] == sorted([*range(60), 105, 106], key=str)
    assert ids["decontamination"] == sorted([*range(60), 106], key=str)
    total = sum(len(r["text"].split()) for r in seen["decontamination"])
    assert abs(sum(len(r["text"].split()) for r in seen["mixing"]) - 1.5 * total) <= 3 and max(map(ids["mixing"].count, ids["mixing"])) <= 2
    whole = {r["doc_id"]: set((r["text"] or "").split()) for r in seen["decontamination"]}
    assert all(set(r["text"].split()) <= whole[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in seen["mixing"])
    assert ids["sharding"] == ids["mixing"] and len({(r["doc_id"], r["shard"]) for r in seen["sharding"]}) == len(set(ids["sharding"]))
    names = [c.split()[0] for c in WIDE.split(", ")]
    assert [list(v[0].asDict()) for k, v in seen.items() if k != "sharding"] == [names] * 4
    assert all(r["k"] == (r["doc_id"] if r["doc_id"] != 106 else 0) for r in seen["sharding"])


def test_empty_tables(spark, tmp_path):
    out = cp.run(spark, write(spark, tmp_path, [], []))
    assert out.collect() == [] and {"doc_id", "slot", "shard"} <= set(out.columns)
