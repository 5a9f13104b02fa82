from collections import Counter

import pyarrow as pa
import pytest
from test_source_audit import SCHEMA, brute, corpus, got

from priceboard.llm import source_audit as sa


def test_texts_of_a_group_in_a_task_make_one_vector(spark):
    """The audit's vectors are as many as the groups of a task, not as its documents, with the same sums."""
    rows = [(r[2] or "", r[3] or "", r[1], ord((r[3] or "s9")[1])) for r in corpus(60, 1)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string, grp int").coalesce(1)
    joined, terms, langs = sa.vectors(docs, min_df=5)
    each, terms_of_each, _ = sa.vectors(docs.drop("grp"), min_df=5)
    assert each.count() == 60 and joined.count() == len({(r[0], r[3]) for r in rows if r[2]}) < 30

    def total(made, vocabulary):
        word = {r["idx"]: (r["lang_no"], r["term"]) for r in vocabulary.collect()}
        out = Counter()
        for r in made.collect():
            key = ord(r["source"][1]) if "source" in made.columns and r["source"] else r["grp"] if "grp" in made.columns else ord("9")
            for i, n in zip(r["indices"], r["values"], strict=True):
                out[r["lang_no"], key, word[i][1]] += n
        return out

    assert total(joined, terms) == total(each, terms_of_each)
    assert sa.group_sums(joined).count() == len(total(joined, terms))


@pytest.mark.parametrize("held, joined", [(sa.HELD_BYTES, sa.JOINED_BYTES), (1000, 350), (500, 10**6), (1, 1)])
def test_no_occurrence_is_lost_wherever_texts_are_cut(spark, monkeypatch, held, joined):
    monkeypatch.setattr(sa, "HELD_BYTES", held)
    monkeypatch.setattr(sa, "JOINED_BYTES", joined)
    texts = ["a b", "", "B", "1 2", "É a", "a", "c-c"] * 3
    groups = [0, 0, 1, 2, 1, 0, 3] * 3
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 21, pa.int32()), pa.array(groups, pa.int32()), pa.array(texts)], ["lang_no", "grp", "text"])
    given = Counter()
    for b in sa._joined()(iter([batch, batch])):
        for g, x in zip(b.column("grp").to_pylist(), b.column("terms").to_pylist(), strict=True):
            given.update((g, t) for t in x.split())
    assert given == {(0, "7a"): 12, (0, "7b"): 6, (1, "7b"): 6, (1, "7É"): 6, (1, "7a"): 6, (3, "7c"): 12}
    rows = corpus(90, 4)
    assert got(sa.audit(spark.createDataFrame([(*r, None) for r in rows], SCHEMA), min_df=3)) == brute(rows, 3)


def test_held_texts_are_bounded_by_number_too(monkeypatch):
    """Very short texts take more memory than their bytes, and empty ones are not held."""
    monkeypatch.setattr(sa, "HELD_BYTES", 1000)
    monkeypatch.setattr(sa, "BLOCK_BYTES", 1)
    n, out = 50, []
    batch = pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([i % 25 for i in range(n)], pa.int32()), pa.array(["x", ""] * (n // 2))], ["lang_no", "grp", "text"])
    out = [b.num_rows for b in sa._joined()(iter([batch]))]
    assert sum(out) == 25 and max(out) <= 10
