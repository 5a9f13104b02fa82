from collections import Counter

from test_source_audit import SCHEMA, brute, corpus, got

import pyarrow as pa
import pytest
from priceboard.llm import source_audit as sa


@pytest.mark.parametrize("most_kept, passes", [(sa.MOST_KEPT, 0), (20, 1)])
def test_estimate_only_where_a_fit_is_full(spark, monkeypatch, most_kept, passes):
    """Texts are not read for an estimate where the first fit keeps all that minDF does; a full fit is no result."""
    asked, slices, vectors = [], sa._slices, sa.vectors
    monkeypatch.setattr(sa, "_slices", lambda rows, most: asked.append(most) or slices(rows, most))
    monkeypatch.setattr(sa, "vectors", lambda docs, min_df, most_terms: vectors(docs, min_df, most_terms, most_kept))
    rows = corpus(120, 5)
    docs = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    assert got(sa.audit(docs, min_df=3)) == brute(rows, 3)
    assert len(asked) == passes


@pytest.mark.parametrize("most_counted", [sa.MOST_COUNTED, 2])
def test_fit_gets_no_more_documents_than_it_needs(monkeypatch, most_counted):
    """A term that min_df texts of a task have had is not given again, unless the task has begun to count anew; no term of fewer texts is lost."""
    monkeypatch.setattr(sa, "MOST_COUNTED", most_counted)
    texts = ["a b a", "a c", "a b", "", "a d", "a"]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 6, pa.int32()), pa.array(["s"] * 6), pa.array(texts)], ["lang_no", "source", "text"])
    given = Counter(t for b in sa._marked(2)(iter([batch])) for x in b.column("terms").to_pylist() for t in x.split())
    df = {"0a": 5, "0b": 2, "0c": 1, "0d": 1}
    assert given.keys() == df.keys() and all(min(n, 2) <= given[t] <= n for t, n in df.items())
    assert most_counted == 2 or given == {"0a": 2, "0b": 2, "0c": 1, "0d": 1}
