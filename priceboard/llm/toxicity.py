"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels.

A sentence's logit is a bias plus the weights of its words; its score p is the logistic of that.  A
document is toxic unless every sentence is not: 1 - prod(1 - p).  A word's weight is the sum of those
of its features: the word and its first four, five and six characters.  Features are screened by a
likelihood-ratio test on documents (only those that go with the label); weights (none below zero) and
bias come from the likelihood of the document labels under the noisy-or, by proximal gradient steps that
set weights without evidence of their own to zero.  The same sentence scores locate the offending sentences.

The fit uses a bounded sample: the first MAX_LABELLED labelled rows by hash.  Counting features and
finding them in sentences are jobs over that sample; what reaches the driver are at most
MAX_FEATURES features and their places.  Scoring is one pass over whole texts.

Sentences end with . ! ? (closing marks may follow) or a line break.  Words are lower-cased (A-Z) and
lose marks around them.

Defined cases: a null or empty text has no sentence and gets score 0; labels without a document and
null labels are left out, and of labels of one document that disagree the greater counts; without any labelled row, or any feature that passes the test, scores come from the
bias alone (below 0.5 for texts of less than some hundred sentences); equal texts get equal scores;
other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_blocks, packed, stored

MAX_LABELLED = 12_000
MAX_FEATURES = 20_000
PREFIXES = (4, 5, 6)
#: A feature needs that many documents of the sample and twice the log of its likelihood ratio.
LEAST_DOCS, LEAST_G = 4, 30.0
STEPS, RATE, L1, START = 1500, 20.0, 2e-4, -6.0
OFFENDING = 0.5
BLOCK_BYTES = 2_000_000
_MARKS = b".,;:!?\"'()[]{}<>*#%&$|"
_LINE = b"\x01"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def features(token: bytes) -> list[int]:
    """Hashes of a token's features (signed 64 bit)."""
    core = token.strip(_MARKS)
    if not core:
        return []
    word = core.decode("utf-8", "ignore")
    parts = [b"w" + core, *(b"p" + word[:k].encode() for k in PREFIXES if len(word) >= k)]
    return [xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in parts]


def _ends(token: bytes) -> bool:
    return token.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?")


class _Tokens(dict):
    """token -> row of self.facts (made by fact(token)) and of self.ends (0, 1, or 2 for a line break); bounded between blocks."""

    LIMIT = 200_000

    def __init__(self, fact):
        super().__init__()
        self.fact, self.facts, self.ends = fact, [], []

    def __missing__(self, token: bytes) -> int:
        self.facts.append(self.fact(token))
        self.ends.append(2 if token == _LINE else int(_ends(token)))
        self[token] = n = len(self.facts) - 1
        return n

    def sentences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token row, its sentence, text of each sentence)."""
        if len(self) > self.LIMIT:
            self.clear()
            self.facts, self.ends = [], []
        tokens, size = [], []
        for t in texts:
            found = t.lower().replace(b"\n", b" \x01 ").split()
            tokens += found
            size.append(len(found))
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        doc = np.repeat(np.arange(len(texts)), size)
        if not len(at):
            return at, at, doc
        end = np.array(self.ends, np.int8)[at]
        starts = np.ones(len(at), bool)
        starts[1:] = (end[:-1] > 0) | (doc[1:] != doc[:-1])
        real = end < 2
        used, sentence = np.unique((np.cumsum(starts) - 1)[real], return_inverse=True)
        return at[real], sentence, doc[np.flatnonzero(starts)[used]]


def _g(n: np.ndarray, k: np.ndarray, docs: int, toxic: int) -> np.ndarray:
    """Twice the log likelihood ratio of a feature in n documents, k of them toxic."""
    base = toxic / docs
    seen = [k, n - k, toxic - k, docs - n - toxic + k]
    due = [n * base, n * (1 - base), (docs - n) * base, (docs - n) * (1 - base)]
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * sum(np.where(o > 0, o * np.log(o / e), 0.0) for o, e in zip(seen, due, strict=True))


def fit(labels: np.ndarray, sizes: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """labels and sentence counts of documents; (doc, sentence within it, feature) wherever a feature occurs.  Weights and bias."""
    w, b, y, n = np.zeros(n_features), START, labels > 0, len(labels)
    if not n or not y.any():
        return w, b
    keys, at = np.unique(doc.astype(np.int64) << 32 | sentence.astype(np.int64), return_inverse=True)
    owner = (keys >> 32).astype(np.int64)
    plain = sizes - np.bincount(owner, minlength=n)  # sentences without any feature
    for _ in range(STEPS):
        z = b + np.bincount(at, w[feature], len(keys))
        total = np.bincount(owner, np.logaddexp(0, z), n) + plain * np.logaddexp(0, b)
        slope = np.where(y, -1 / np.expm1(np.clip(total, 1e-3, 500)), 1.0) / n
        dz = slope[owner] / (1 + np.exp(-np.clip(z, -500, 500)))
        db = dz.sum() + (slope * plain).sum() / (1 + math.exp(-b))
        w = np.maximum(w - RATE * (np.bincount(feature, dz[at], n_features) + L1), 0)
        b -= RATE * 0.05 * min(1.0, max(-1.0, db))
    return w, b


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELLED) -> tuple[dict[int, float], float]:
    """(weight of each feature that has one, bias)."""
    sample = packed(labels, __id=key, __label=label).filter("__id is not null and __label is not null").groupBy("__id").agg((F.max("__label") > 0).alias("__label"))
    sample = sample.orderBy(F.xxhash64("__id"), "__id").limit(most)  # at most that many rows: may be broadcast
    rows = packed(docs, __id=key, __text=text).select("__id", F.coalesce("__text", F.lit("")).cast("binary").alias("__text"))
    rows = rows.join(F.broadcast(sample), "__id").select("__id", "__text", "__label")

    def counted(batches):
        words = _Tokens(features)
        for batch in batches:
            texts, flags, seen = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
            for t in texts:
                at, _, _ = words.sentences([t])
                seen.append(np.array(sorted({f for i in set(at.tolist()) for f in words.facts[i]}), np.int64))
            f, where = np.unique(np.concatenate([np.zeros(0, np.int64), *seen]), return_inverse=True)
            toxic = np.repeat(np.array(flags, bool), [len(x) for x in seen])
            n, k = np.bincount(where, minlength=len(f)), np.bincount(where[toxic], minlength=len(f))
            # the row of feature 0 counts documents
            cols = [np.append(f, 0), np.append(n, len(texts)), np.append(k, sum(flags))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["f", "n", "k"])

    counts = rows.mapInArrow(counted, "f long, n long, k long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    counts = stored(counts, "features")
    whole = counts.filter("f = 0").first()
    if whole is None or not whole["k"] or whole["k"] == whole["n"]:
        return {}, START
    total, toxic = whole["n"], whole["k"]
    likely = counts.filter((F.col("f") != 0) & (F.col("n") >= LEAST_DOCS) & (F.col("k") * total > F.col("n") * toxic))
    likely = likely.orderBy(F.desc(F.col("k") / F.sqrt("n")), "f").limit(MAX_FEATURES).toPandas()
    good = likely[_g(likely["n"].to_numpy(), likely["k"].to_numpy(), total, toxic) >= LEAST_G]
    number = {f: i for i, f in enumerate(sorted(good["f"]))}
    held = docs.sparkSession.sparkContext.broadcast(number)

    def placed(batches):
        known = held.value
        words = _Tokens(lambda t: [known[f] for f in features(t) if f in known])
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                at, sentence, d = words.sentences([t])
                spots = [(s, f) for i, s in zip(at.tolist(), sentence.tolist(), strict=True) for f in words.facts[i]]
                out.append((len(d), [s for s, _ in spots], [f for _, f in spots]))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], kind), pa.array([o[2] for o in out], kind)], ["id", "label", "n", "s", "f"])

    kind = rows.schema["__id"].dataType.simpleString()
    got = rows.mapInArrow(placed, f"id {kind}, label boolean, n int, s array<int>, f array<int>").toPandas().sort_values("id", kind="stable")
    size = got["f"].map(len).to_numpy()
    flat = lambda c: np.concatenate([np.zeros(0, np.int64), *map(np.asarray, got[c])]).astype(np.int64)
    w, b = fit(got["label"].to_numpy(), got["n"].to_numpy(), np.repeat(np.arange(len(got)), size), flat("s"), flat("f"), len(number))
    return {f: float(w[i]) for f, i in number.items() if w[i] > 0}, b


def _split(text: bytes) -> list[bytes]:
    """The sentences of a text, in order: the same as those that _Tokens numbers."""
    out = []
    for line in text.split(b"\n"):
        start = end = None
        for m in _WORD.finditer(line):
            if m[0] != _LINE:
                start, end = m.start() if start is None else start, m.end()
            if start is not None and (m[0] == _LINE or _ends(m[0])):
                out.append(line[start:end])
                start = None
        if start is not None:
            out.append(line[start:end])
    return out


def score(docs: DataFrame, model: tuple[dict[int, float], float], key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """id, score, and with spans the offending sentences in order: array<struct<sentence, score>>."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights
    rows = packed(docs, __id=key, __text=text).select(F.col("__id").alias("id"), F.coalesce("__text", F.lit("")).cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))

    def run(batches):
        weights, bias = held.value
        words = _Tokens(lambda t: sum(weights.get(f, 0.0) for f in features(t)))

        def parts(texts):
            at, sentence, doc = words.sentences(texts)
            z = bias + np.bincount(sentence, np.array(words.facts)[at], len(doc)) if len(at) else np.zeros(0)
            return np.logaddexp(0, z), doc

        for batch in batches:
            for a, b in byte_blocks(batch.column(1), BLOCK_BYTES):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                cost, doc = parts(texts)
                cols, names = [batch.column(0).slice(a, b - a), pa.array(-np.expm1(-np.bincount(doc, cost, b - a)))], ["id", "score"]
                if spans:
                    hot, marks = np.flatnonzero(cost >= -math.log1p(-OFFENDING)), [[] for _ in range(b - a)]
                    first = np.searchsorted(doc, np.arange(b - a))
                    for i in np.unique(doc[hot]):  # only these texts are cut into sentences
                        own, parts_of = hot[doc[hot] == i], _split(texts[i])
                        marks[i] = [{"sentence": parts_of[k - first[i]].decode("utf-8", "replace"), "score": float(-np.expm1(-cost[k]))} for k in own]
                    cols.append(pa.array(marks, kind))
                    names.append("offending")
                yield pa.RecordBatch.from_arrays(cols, names)

    key_kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {key_kind}, score double" + (", offending array<struct<sentence:string,score:double>>" if spans else ""))
