from collections import defaultdict

from priceboard.llm import line_dedup as ld


def rows():
    shared = "all rights reserved by  us"
    out = [(i, f"own line number {i} here\n{shared}\nok", "en", f"s{i % 9}") for i in range(30)]
    near = "this line is at five sites"
    out += [(100 + i, f"{near}\n\ttail of the text {i} is own", "en", f"s{i}") for i in range(5)]
    out += [(200 + i, "this line is at four sites", "en", f"s{i % 4}") for i in range(12)]
    out += [(250 + i, f"Read more\nabout {i}", "en", f"s{i}") for i in range(12)]
    return out + [(300, None, None, None), (301, "", "en", "s1"), (302, f" {shared.replace('  ', ' ')} ", "en", None), (302, f" {shared.replace('  ', ' ')} ", "en", None), (None, shared, "en", "s1")]


def brute(docs):
    sites = defaultdict(set)
    plain = lambda x: " ".join(x.split())
    for _, t, _, s in docs:
        for x in (t or "").split("\n"):
            if plain(x):
                sites[plain(x)].add(s)
    need = lambda x: ld.SITES if len(x.split()) >= ld.WORDS else ld.SITES_SHORT
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if len(sites.get(plain(x), ())) < need(x))) for i, t, _, _ in docs]


def test_against_brute_force(make):
    got = ld.dedup_lines(make(rows()))
    assert got.columns == make([]).columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted((str(i), str(t)) for i, t in brute(rows()))


def test_empty(make):
    assert ld.dedup_lines(make([])).collect() == []


def test_clashing_columns_and_a_long_text(spark):
    text = "\n".join(f"line number {i % 50} of many" for i in range(100_000))
    docs = spark.createDataFrame([(i, text if i == 0 else "line number 7 of many", f"s{i}", "x", 1, True) for i in range(6)], "doc_id long, text string, source string, h string, at int, short boolean")
    got = {r["doc_id"]: r for r in ld.dedup_lines(docs).collect()}
    assert got[1]["text"] == "" and got[0]["text"].count("\n") == 97_999 and got[0]["h"] == "x"
