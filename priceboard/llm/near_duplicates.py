"""Near-duplicate classes: ProbMinHash of weighted shingles, banding, verification.

Texts are sets of five-word shingles weighted by their number in the text; their similarity is the
probability Jaccard index (the Jaccard index where nothing repeats).  Each shingle starts a Poisson
process whose rate is its weight; every arrival falls in one of M components, and a component keeps
the shingle that arrived first.  A process stops once its next arrival is later than all that its
text has kept.  Two texts agree in a component with the probability that is their index.

Each of BANDS bands reads ROWS components, chosen at random among the M, and gives a bucket; at an
index of 0.8 a pair shares no bucket with a probability of 5.1e-5 (the bands share components, so this is summed over
the number of components that agree), and at 0.25 it shares one with 0.3 %, so groups of loosely related texts
do not fill buckets with pairs.  Texts of a bucket are compared with its first and last member, exactly and
over whole texts; links are folded to classes.

What is left are buckets whose members are not yet all of one class: their texts are joined exactly, by their rare
shingles, without all pairs of a group.  Shingles are ordered by their number among these texts, rarest first.  Let a
and b be the shares of weight that two texts have before their first common shingle: none of it is common, so
their index is at most (1 - a)(1 - b) / (1 - a b).  Therefore a pair at the threshold has its first common shingle
where each text has at most 1 - threshold before it, and texts are joined by such shingles, with that bound in the
join; pairs of one class and pairs that meet at the shingle just before as well are left out.  Where a shingle
is frequent, each text brings PARITY bits too, each the parity of the number of its shingles that fall there: bits
that differ are shingles of one text alone, which gives least values of a and b in the same bound.
Texts that share a frequent passage or are looser copies of one text have more than that share of their own, and so do
not meet at all.  Equal texts meet by their 64-bit hash alone and are compared once.

Defined cases: a null text counts as an empty one; empty or blank texts have no shingles and are copies of equal texts only;
a text of one to four words is one shingle; class_id is the least id of the class (null ids count
last); repeated rows are copies; texts of any length are read whole, in blocks of bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, byte_blocks, mix, packed, stored, windows

SHINGLE = 5
THRESHOLD = 0.8
COMPONENTS, BANDS, ROWS = 256, 56, 7
#: Bytes of text that a task hashes at once.
BLOCK_BYTES, PARITY_BYTES = 2_000_000, 500_000
#: Bits of a text's parities, and texts of a shingle from which they are used.
PARITY, FREQUENT = 1024, 32
#: What sums of shares may be off by.
ROUNDING = 1e-9
_BITS = [f"b{i}" for i in range(PARITY // 64)]


def shingles(texts: list[bytes], words: WordHash, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, weight, number of the text) for the distinct shingles of each text, by text and hash."""
    tokens = [t.split() for t in texts]
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    all_words = words.of(list(chain.from_iterable(tokens)))
    start = np.cumsum(size) - size
    h = windows(all_words, n)
    count = np.maximum(size - n + 1, 0)
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
    h = h[at]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        extra = np.array([windows(all_words[start[i] : start[i] + size[i]], int(size[i]))[0] ^ np.uint64(size[i]) for i in short], np.uint64)
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
        count[short] = 1
    ends = np.cumsum(count)
    for a, b in zip(ends - count, ends, strict=True):
        h[a:b].sort()
    if not len(h):
        return h, np.empty(0), doc
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    return h[new], np.diff(np.append(new, len(h))).astype(float), doc[new]


def prob_min_hash(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m: which element of the text came first in each component (0 for a text without any)."""
    first, who = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    time, going, k = np.zeros(len(elements)), np.arange(len(elements)), 0
    last = np.full(n_docs, np.inf)
    while len(going):
        e, d = elements[going], doc[going]
        u = ((mix(e + np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        part = (mix(e + np.uint64((0x9E3779B97F4A7C15 * (2 * k + 2)) & (2**64 - 1))) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        t = time[going] - np.log(u) / weights[going]
        slot = d * m + part.astype(np.int64)
        early = np.flatnonzero(t < first[slot])
        early = early[np.argsort(-t[early], kind="stable")]  # of equal slots the earliest is written last
        first[slot[early]], who[slot[early]] = t[early], e[early]
        changed = np.unique(d[early])
        last[changed] = first.reshape(n_docs, m)[changed].max(axis=1)
        time[going] = t
        going, k = going[t < last[d]], k + 1
    return who.reshape(n_docs, m)


def bands(texts: list[bytes], words: WordHash) -> list[list[int]]:
    """Bucket numbers of each text (none for a text without words)."""
    h, w, doc = shingles(texts, words)
    sig = prob_min_hash(h, w, doc, len(texts), COMPONENTS)
    chosen = np.argsort(np.random.default_rng(0).random((BANDS, COMPONENTS)), axis=1)[:, :ROWS]
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(texts), BANDS)).copy()
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, chosen[:, r]])
    has = np.bincount(doc, minlength=len(texts)) > 0
    return [row.tolist() if ok else [] for row, ok in zip(out.view(np.int64), has, strict=True)]


def similarity(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Probability Jaccard index of two weighted sets (hashes sorted)."""
    if not len(h1) or not len(h2):
        return float(len(h1) == len(h2))
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if w1.max() == 1 and w2.max() == 1:
        return len(i) / (len(h1) + len(h2) - len(i))
    only1, only2 = w1.sum() - w1[i].sum(), w2.sum() - w2[j].sum()
    order = np.argsort(w1[i] / w2[j], kind="stable")
    x, y = w1[i][order], w2[j][order]
    # sum over all j of max(x_j / x_i, y_j / y_i): those of a larger ratio x_j / y_j count by x, the others by y
    by_x, by_y = (x.sum() - np.cumsum(x)) + only1, np.cumsum(y) + only2
    return float((1 / (by_x / x + by_y / y)).sum())


def _hashed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """__row, __id, __text (bytes), __k (hash of the text), __idk (the id as a text, never null)."""
    rows = packed(docs, __text=text, __id=key)
    rows = rows.withColumn("__text", F.coalesce(F.col("__text"), F.lit("")).cast("binary"))
    return rows.withColumns({"__k": F.xxhash64("__text"), "__idk": F.coalesce(F.concat(F.lit("="), F.col("__id").cast("string")), F.lit("null"))})


def _sketched(batches):
    words = WordHash()
    for batch in batches:
        for a, b in byte_blocks(batch.column(1), BLOCK_BYTES):
            found = bands(batch.column(1).slice(a, b - a).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.list_(pa.int64()))], ["k", "bands"])


def _shares(batches):
    words = WordHash()
    for batch in batches:
        for a, b in byte_blocks(batch.column(1), BLOCK_BYTES):
            h, w, doc = shingles(batch.column(1).slice(a, b - a).to_pylist(), words)
            total = np.bincount(doc, w, b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(h.view(np.int64)), pa.array(w / total[doc])], ["k", "h", "share"])


def parities(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """PARITY bits of each text, 64 to a number: the parity of the number of its distinct shingles that fall on a bit."""
    bit = (mix(h) >> np.uint64(40)).astype(np.int64) % PARITY
    odd = np.bincount(doc * PARITY + bit, minlength=n_docs * PARITY) & 1
    return np.packbits(odd.reshape(n_docs, PARITY).astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def _summed_up(batches):
    words = WordHash()
    for batch in batches:
        for a, b in byte_blocks(batch.column(1), PARITY_BYTES):
            h, w, doc = shingles(batch.column(1).slice(a, b - a).to_pylist(), words)
            bits = parities(h, doc, b - a)
            columns = [np.bincount(doc, w, b - a), np.bincount(doc, minlength=b - a).astype(float), *bits.T.copy()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, columns)], ["k", "weight", "distinct", *_BITS])


def _verified(batches):
    words, known = WordHash(), {}

    def sets(k: int, text: bytes):
        if k not in known:
            if len(known) >= 256:
                known.clear()
            known[k] = shingles([text], words)[:2]
        return known[k]

    for batch in batches:
        a, b, ta, tb = (c.to_pylist() for c in batch.columns)
        sims = [similarity(*sets(x, tx), *sets(y, ty)) for x, y, tx, ty in zip(a, b, ta, tb, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sims, pa.float64())], ["a", "b", "similarity"])


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b.  k and c, the least node of its component, for every node but that least one.  Large-star and small-star in
    turn, each a partial minimum by node and a join, until nothing changes; the frames are written between."""
    e = edges.filter("a <> b").select(F.least("a", "b").alias("c"), F.greatest("a", "b").alias("k")).distinct()
    e, was = stored(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(c, k))")).first()
        if now == was or not now[0]:
            return e
        was = now
        both = e.select(F.col("k").alias("u"), F.col("c").alias("v")).union(e.select(F.col("c").alias("u"), F.col("k").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("c"), F.col("v").alias("k")).distinct()
        low = large.groupBy("k").agg(F.min("c").alias("m"))
        small = large.join(low, "k").filter("c <> m").select(F.col("m").alias("c"), F.col("c").alias("k"))
        e = stored(small.union(low.select(F.col("m").alias("c"), "k")).distinct(), "edges")


def links(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(a row per row of docs: id, idk, k; for the k that are linked to others: k, c)."""
    if threshold < THRESHOLD:
        raise ValueError(f"the bands are made for a threshold of {THRESHOLD} or more")
    rows = _hashed(docs, text, key)
    members = stored(rows.select(F.col("__id").alias("id"), F.col("__idk").alias("idk"), F.col("__k").alias("k")), "members")
    sketches = rows.select("__k", "__text").mapInArrow(_sketched, "k bigint, bands array<bigint>")
    sketches = stored(sketches, "bands")
    rows_of = sketches.select("k", F.explode("bands").alias("bucket"))
    ends = rows_of.groupBy("bucket").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo <> hi")
    shared = stored(rows_of.join(ends, "bucket").distinct(), "buckets")
    # one row of docs for each text that shares a bucket
    needed = members.groupBy("k").agg(F.min("idk").alias("idk")).join(shared.select("k").distinct(), "k")
    texts = rows.select(F.col("__k").alias("k"), F.col("__idk").alias("idk"), F.col("__text").alias("text"))
    texts = stored(texts.join(needed, ["k", "idk"]).select("k", "text").dropDuplicates(["k"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.withColumnsRenamed({"k": "a", "text": "ta"}), "a")
        both = with_a.join(texts.withColumnsRenamed({"k": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb")
        return both.mapInArrow(_verified, "a bigint, b bigint, similarity double").filter(F.col("similarity") >= threshold)

    stars = shared.filter("k <> lo").select(F.col("lo").alias("a"), F.col("k").alias("b"))
    stars = stars.union(shared.filter("k <> hi and k <> lo").select(F.col("k").alias("a"), F.col("hi").alias("b")))
    tried = stored(stars.distinct(), "pairs")
    found = stored(verified(tried), "links")
    classes = components(found)

    # what may be left: texts of buckets of several classes
    classed = shared.select("bucket", "k").join(classes, "k", "left").withColumn("c", F.coalesce("c", "k"))
    several = classed.groupBy("bucket").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least <> most").select("bucket")
    open_ = stored(classed.join(several, "bucket").select("k", "c").distinct(), "open")
    rest = stored(rare_pairs(texts, open_, threshold).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = stored(verified(rest), "links")
    if more.isEmpty():
        return members, classes
    return members, components(classes.select(F.col("c").alias("a"), F.col("k").alias("b")).union(more.select("a", "b")))


def rare_pairs(texts: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """texts: k, text; classes: k, c.  The pairs a, b of these texts, of different classes, that may reach the threshold."""
    shares = texts.join(classes.select("k"), "k").select("k", "text").mapInArrow(_shares, "k bigint, h bigint, share double")
    shares = stored(shares, "shares")
    number = shares.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    # shingles of one text alone come first and meet nothing
    by_rarity = Window.partitionBy("k").orderBy(F.coalesce("n", F.lit(1)), "h")
    before = F.coalesce(F.sum("share").over(by_rarity.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = shares.join(number, "h", "left").withColumns({"before": before, "earlier": F.coalesce(F.lag("h").over(by_rarity), "k")})
    prefix = ranked.filter((F.col("n").isNotNull()) & (F.col("before") <= 1 - threshold + ROUNDING))
    prefix = stored(prefix.join(classes, "k").select("h", "k", "c", "before", "earlier", (F.col("n") > FREQUENT).alias("frequent")), "prefix")
    by_earlier = prefix.groupBy("h", "earlier").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most"))
    usual = by_earlier.groupBy("h").agg(F.max(F.struct("n", "earlier")).alias("top"), F.min("least").alias("least"), F.max("most").alias("most"))
    met = prefix.join(usual.filter("least <> most").select("h", F.col("top.earlier").alias("usual")), "h")
    # texts with the same shingle before have met there: those with the usual one are met by the others, and these in order
    once = F.expr("p.h = o.h and p.earlier <> o.earlier and (o.earlier = o.usual or o.k < p.k) and p.c <> o.c")
    once &= _may_reach(F.col("p.before"), F.col("o.before"), threshold)
    few, many = met.filter(~F.col("frequent")), met.filter("frequent")
    pairs = few.filter("earlier <> usual").alias("p").join(few.alias("o"), once).select("p.k", F.col("o.k").alias("l"))
    fields = ", ".join(f"{b} bigint" for b in _BITS)
    looked_at = texts.join(many.select("k").distinct(), "k").select("k", "text")
    sums = stored(looked_at.mapInArrow(_summed_up, f"k bigint, weight double, distinct double, {fields}"), "parities")
    many = many.join(sums, "k")
    differ = sum((F.bit_count(F.col(f"p.{b}").bitwiseXOR(F.col(f"o.{b}"))) for b in _BITS), F.lit(0)).cast("double")
    alone = (differ + F.col("p.distinct") - F.col("o.distinct")) / 2, (differ + F.col("o.distinct") - F.col("p.distinct")) / 2
    close = _may_reach(F.greatest(alone[0], F.lit(0.0)) / F.col("p.weight"), F.greatest(alone[1], F.lit(0.0)) / F.col("o.weight"), threshold)
    pairs = pairs.union(many.filter("earlier <> usual").alias("p").join(many.alias("o"), once & close).select("p.k", F.col("o.k").alias("l")))
    return pairs.select(F.least("k", "l").alias("a"), F.greatest("k", "l").alias("b")).distinct()


def _may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether texts whose shares a and b are not common may be as similar as the threshold."""
    return (1 - a) * (1 - b) >= threshold * (1 - a * b) - ROUNDING


def _labelled(members: DataFrame, classes: DataFrame) -> DataFrame:
    return members.join(classes, "k", "left").withColumn("c", F.coalesce("c", "k"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of docs: its id, class_id (the least id of its class), class_rows (rows of its class)."""
    labelled = _labelled(*links(docs, text, key, threshold))
    names = labelled.groupBy("c").agg(F.min("id").alias("class_id"), F.count("*").alias("class_rows"))
    return labelled.join(names, "c").select(F.col("id").alias(key), "class_id", "class_rows")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The row of the least id of each class, with docs' own columns."""
    labelled = _labelled(*links(docs, text, key, threshold))
    # a null id counts last; of equal rows one stays
    winner = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "k", "idk")).alias("w")
    winners = labelled.groupBy("c").agg(winner).select(F.col("w.k").alias("__k"), F.col("w.idk").alias("__idk"))
    kept = _hashed(docs, text, key).join(winners, ["__k", "__idk"])
    first = F.row_number().over(Window.partitionBy("__k", "__idk").orderBy("__k"))
    return kept.withColumn("__nth", first).filter("__nth = 1").select("__row.*")
