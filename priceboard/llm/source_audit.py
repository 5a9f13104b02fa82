"""How the sources of each lang differ in their words.

Every document becomes an exact sparse vector of term counts by Spark's CountVectorizer, with minDF and the largest integer as vocabSize, so the
vocabulary is all that minDF keeps; the audit, which needs sums alone, lets the texts that a task holds of a (lang, source) be one document when vectors are made.  The fit, which counts documents, gets each term of a text once, and no term from one task in more documents than minDF asks for: a term of
minDF documents in one task is kept whatever the others have, and of a term that no task has so often each document is counted.  Terms that the first task's texts show
to be kept are certain: the fit gets them in minDF rows of their own, and from no text.  The vectors are made of all occurrences.  A term carries the number of its lang, so that one fit makes the vocabularies of all langs side by
side, each with its own document frequencies, and one pass over the texts serves any number of langs.  A vocabulary is on the driver and in every
executor; therefore it is bounded: the first fit may keep MOST_KEPT terms, and holds if it kept fewer, since then minDF alone has chosen.  Else the
distinct terms are estimated, and where they are more than MOST_TERMS terms are dealt into slices by hash, each with a
CountVectorizer of its own; all sums that follow are sums over slices.  Models and the sums of
vectors are written to spark.checkpoint.dir.

The vectors are summed by (lang, source) as Summarizer does, but sparsely: a partial sum for each term that occurs, in place of arrays as long as
the vocabulary.  Each kept term has the share p = 1 + floor(1000000000 * (count + 2) / (N + 2 * V)) in a group, and two groups differ by
the sum of floor((p - q)**2 / (p + q)).  Pairs are evaluated on the sums: the entries of a block of terms and of two tiles of sources meet in a
task, which returns one number for each pair; terms that no source of the tiles has add one known number each.  All numbers are integers.

Defined cases: null text, lang and source count as ''; a document without terms still makes its group occur; repeated rows count each; without kept terms (V = 0)
pairs have the value 0; an empty table gives an empty result; texts are read whole; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import shared_dir
from .common import byte_blocks, packed, stored

MIN_DF, MOST_TERMS, MOST_KEPT, MOST_LANGS = 10, 4_000_000, 1_000_000, 10_000
LARGEST_INT = 2**31 - 1
UNIT = 1_000_000_000
#: The largest count of which UNIT times two more fits 64 bits.
LONG_COUNT = (2**63 - 1) // UNIT - 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a task cuts to terms at once.
BLOCK_BYTES = 4_000_000
#: Terms whose documents a task of the fit counts before it begins anew.
MOST_COUNTED = 300_000
#: Bytes of the first task's text in which terms are looked for that are certain to be kept, and such terms in a row of the fit.
CERTAIN_BYTES, CERTAIN_ROW = 24_000_000, 1000
#: Bytes of text that a task holds to join the texts of a group, bytes of joined text in a row, and bytes that a held text counts besides its own.
HELD_BYTES, JOINED_BYTES, HELD_TEXT = 24_000_000, 1_000_000, 100
#: Terms in a block and sources in a tile of the pair evaluation.
BLOCK, TILE = 4096, 128
TOP = 10


def documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, text."""
    rows = packed(docs, __t=text, __l=lang, __s=source)
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (("__l", "lang"), ("__s", "source"), ("__t", "text"))))


#: A byte of UTF-8 text as it stands in a term, or a space: bytes of 128 and more belong to letters and marks beyond ASCII, which no term boundary can cut.
_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def _marked(min_df: int | None, k: int = 0, n_slices: int = 1, certain: dict[int, bytes] | None = None):
    """Terms of each row as one string with spaces between, each led by the digits of its lang; all of them, or each term of a text once, with min_df, and of a term that
    min_df texts of the task have had no more, nor of one that is certain.  Of several slices, slice k."""

    def run(batches):
        had, counted = {}, 0
        known = {lang: frozenset(terms.split()) for lang, terms in (certain or {}).items()}

        def wanted(lang, terms):
            nonlocal had, counted
            of, out = had.setdefault(lang, {}), []
            get, before = of.get, len(of)
            for t in terms:
                n = get(t, 0)
                if n < min_df:
                    of[t] = n + 1
                    out.append(t)
            counted += len(of) - before
            if counted > MOST_COUNTED:
                had, counted = {}, 0
            return out

        for batch in batches:
            for first, last in byte_blocks(batch.column("text"), BLOCK_BYTES):
                b, out = batch.slice(first, last - first), []
                for lang, text in zip(b.column("lang_no").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    own = text.translate(_BYTES).split()
                    if n_slices > 1:
                        own = [t for t in own if zlib.crc32(t) % n_slices == k]
                    if min_df is not None:
                        own = wanted(lang, set(own).difference(known.get(lang, ())))
                    mark = str(lang).encode()
                    out.append(mark + (b" " + mark).join(own) if own else b"")
                yield pa.RecordBatch.from_arrays([b.column("lang_no"), b.column("source"), pa.array(out, pa.binary()).view(pa.string())], ["lang_no", "source", "terms"])

    return run


def _joined(k: int = 0, n_slices: int = 1):
    """As _marked, all terms, but by grp in place of source, and the texts of a group joined while a task holds them."""

    def run(batches):
        held, size = {}, 0

        def batch_of(keys):
            out = []
            for key in keys:
                own = b" ".join(held.pop(key)[1]).translate(_BYTES).split()
                if n_slices > 1:
                    own = [t for t in own if zlib.crc32(t) % n_slices == k]
                mark = str(key[0]).encode()
                out.append(mark + (b" " + mark).join(own) if own else b"")
            langs, groups = (pa.array([key[i] for key in keys], pa.int32()) for i in range(2))
            return pa.RecordBatch.from_arrays([langs, groups, pa.array(out, pa.binary()).view(pa.string())], ["lang_no", "grp", "terms"])

        def all_held():
            keys, n = [], 0
            for key in list(held):
                keys.append(key)
                n += held[key][0]
                if n >= JOINED_BYTES:
                    yield batch_of(keys)
                    keys, n = [], 0
            if keys:
                yield batch_of(keys)

        for batch in batches:
            for first, last in byte_blocks(batch.column("text"), BLOCK_BYTES):
                b = batch.slice(first, last - first)
                for lang, grp, text in zip(b.column("lang_no").to_pylist(), b.column("grp").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    if not text:
                        continue
                    of = held.setdefault((lang, grp), [0, []])
                    of[0] += len(text) + HELD_TEXT
                    of[1].append(text)
                    size += len(text) + HELD_TEXT
                    if of[0] >= JOINED_BYTES:
                        size -= of[0]
                        yield batch_of([(lang, grp)])
                if size >= HELD_BYTES:
                    yield from all_held()
                    size = 0
        yield from all_held()

    return run


def _lists(marked, key: str = "source"):
    """What marked gives, with its terms as a list; null for none."""

    def run(batches):
        for b in marked(batches):
            terms = b.column("terms")
            lists = pc.split_pattern(pc.if_else(pc.equal(terms, ""), pa.scalar(None, pa.string()), terms), " ")
            yield pa.RecordBatch.from_arrays([b.column("lang_no"), b.column(key), lists], ["lang_no", key, "tokens"])

    return run


def tokens(rows: DataFrame, min_df: int | None, k: int = 0, n_slices: int = 1, certain: dict[int, bytes] | None = None) -> DataFrame:
    """rows: lang_no, source, text.  lang_no, source, tokens (array of strings): all, or with min_df what a fit needs."""
    made = rows.select("lang_no", "source", "text").mapInArrow(_lists(_marked(min_df, k, n_slices, certain)), "lang_no int, source string, tokens array<string>")
    return made.select("lang_no", "source", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def joined_tokens(rows: DataFrame, k: int = 0, n_slices: int = 1) -> DataFrame:
    """rows: lang_no, grp, text.  lang_no, grp, tokens: all tokens of the texts of a group that a task holds, in a row or several."""
    made = rows.select("lang_no", "grp", "text").mapInArrow(_lists(_joined(k, n_slices), "grp"), "lang_no int, grp int, tokens array<string>")
    return made.filter("tokens IS NOT NULL")


def _certain(rows: DataFrame, min_df: int) -> dict[int, bytes]:
    """By lang, terms with spaces between that min_df documents have among the first ones of the first task that has rows: whatever the others have, they are kept.  One task
    reads, CERTAIN_BYTES or MOST_COUNTED terms at most."""

    def found(batches):
        had, read, any_row = {}, 0, False
        for batch in batches:
            any_row = any_row or batch.num_rows > 0
            for first, last in byte_blocks(batch.column("text"), BLOCK_BYTES):
                if read >= CERTAIN_BYTES or sum(map(len, had.values())) > MOST_COUNTED:
                    break
                b = batch.slice(first, last - first)
                for lang, text in zip(b.column("lang_no").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    had.setdefault(lang, Counter()).update(set(text.translate(_BYTES).split()))
                    read += len(text)
        if any_row:
            terms = [b" ".join(t for t, n in of.items() if n >= min_df) for of in had.values()]
            yield pa.RecordBatch.from_arrays([pa.array([list(had)], pa.list_(pa.int32())), pa.array([terms], pa.list_(pa.binary()))], ["langs", "terms"])

    row = rows.select("lang_no", "text").mapInArrow(found, "langs array<int>, terms array<binary>").first()
    return {lang: bytes(terms) for lang, terms in zip(row["langs"], row["terms"], strict=True) if terms} if row else {}


def _certain_tokens(spark: SparkSession, certain: dict[int, bytes], min_df: int, k: int, n_slices: int) -> DataFrame:
    """tokens: each certain term of slice k in min_df rows."""

    def run(batches):
        for b in batches:
            for lang, terms in certain.items():
                mark = str(lang).encode()
                own = [mark + t for t in terms.split() if zlib.crc32(t) % n_slices == k]
                rows = [[t.decode() for t in own[i : i + CERTAIN_ROW]] for i in range(0, len(own), CERTAIN_ROW)]
                for _ in range(b.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["tokens"])

    return spark.range(0, min_df, 1, 1).mapInArrow(run, "tokens array<string>")


def _slices(rows: DataFrame, most_terms: int) -> int:
    """Slices in which no vocabulary has more than most_terms terms: by a HyperLogLog estimate of all distinct terms, raised by six standard errors.  A task sends each term
    of a batch once."""

    def distinct(batches):
        for b in batches:
            seen = {}
            for lang, text in zip(b.column("lang_no").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                seen.setdefault(lang, set()).update(text.translate(_BYTES).split())
            yield pa.RecordBatch.from_arrays([pa.array([mark + t for mark, own in ((str(lang).encode(), own) for lang, own in seen.items()) for t in own], pa.binary())], ["t"])

    found = rows.select("lang_no", "text").mapInArrow(distinct, "t binary")
    n = found.agg(F.hll_sketch_estimate(F.hll_sketch_agg("t", F.lit(12)))).first()[0]
    return max(1, -(-int(n * 1.1) // most_terms))


def _langs(rows: DataFrame) -> DataFrame:
    names = [r[0] for r in rows.select("lang").distinct().limit(MOST_LANGS + 1).collect()]
    if len(names) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} langs")
    return rows.sparkSession.createDataFrame(list(enumerate(sorted(names))), "lang_no int, lang string").coalesce(1)


def _fitted(rows: DataFrame, min_df: int, most: int, k: int = 0, n_slices: int = 1, certain: dict[int, bytes] | None = None) -> tuple[CountVectorizerModel | None, str, int]:
    """The model of slice k, its folder (it lies in model) and its number of terms; no model where minDF keeps no term.  Of more than most terms it has most."""
    at = f"{shared_dir(rows.sparkSession)}/terms-{uuid.uuid4().hex}"
    given = tokens(rows, min_df, k, n_slices, certain).select("tokens")
    if certain:
        given = given.unionByName(_certain_tokens(rows.sparkSession, certain, min_df, k, n_slices))
    try:
        model = CountVectorizer(inputCol="tokens", outputCol="counts", minDF=float(min_df), vocabSize=most).fit(given)
    except IllegalArgumentException as e:
        if "vocabulary size should be > 0" not in str(e):
            raise
        return None, at, 0
    model.write().save(f"{at}/model")
    return model, at, rows.sparkSession.read.parquet(f"{at}/model/data").select(F.size("vocabulary")).first()[0]


def vectors(docs: DataFrame, min_df: int = MIN_DF, most_terms: int = MOST_TERMS, most_kept: int = MOST_KEPT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: lang, source, text.  Vectors (slice, lang_no, source, indices, values: a row for each document and slice), vocabulary (slice, idx, lang_no, term)
    and langs (lang_no, lang).  Of docs with grp, the number of a group within its lang, vectors have grp for source, and one is of all texts of a group that a task holds."""
    spark = docs.sparkSession
    key, of = ("grp", "int") if "grp" in docs.columns else ("source", "string")
    langs = stored(_langs(docs), "langs")
    rows = docs.join(F.broadcast(langs), "lang")
    made = [spark.createDataFrame([], f"slice int, lang_no int, {key} {of}, indices array<int>, values array<double>")]
    vocabulary = [spark.createDataFrame([], "slice int, idx int, lang_no int, term string")]
    most = min(most_kept, most_terms)
    certain = _certain(rows, min_df)
    first = _fitted(rows, min_df, most, certain=certain)
    n_slices = 1 if first[2] < most else _slices(rows, most_terms)  # as many as it may keep: there may be more
    for k in range(n_slices):
        model, at, _ = first if first[2] < most else _fitted(rows, min_df, LARGEST_INT, k, n_slices, certain)
        if model is None:
            continue
        given = joined_tokens(rows, k, n_slices) if key == "grp" else tokens(rows, None, k, n_slices)
        counts = model.transform(given).select("lang_no", key, F.unwrap_udt("counts").alias("counts"))
        made.append(counts.select(F.lit(k).alias("slice"), "lang_no", key, "counts.indices", "counts.values"))
        words = spark.read.parquet(f"{at}/model/data").select(F.posexplode("vocabulary").alias("idx", "word"))
        vocabulary.append(words.select(F.lit(k).alias("slice"), "idx", F.regexp_extract("word", "^[0-9]+", 0).cast("int").alias("lang_no"), F.regexp_replace("word", "^[0-9]+", "").alias("term")))
    return _union(made), _union(vocabulary), langs


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def group_sums(found: DataFrame) -> DataFrame:
    """slice, lang_no, grp, idx, n: the sparse sums of the vectors of each group.  A task has few vectors of a group, so entries are dealt before they are summed."""
    keys = ["slice", "lang_no", "grp", "idx"]
    each = found.select("slice", "lang_no", "grp", F.inline(F.arrays_zip(F.col("indices").alias("idx"), F.col("values").alias("n"))))
    return each.select(*keys, F.col("n").cast("long").alias("n")).repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"))


def _share(n: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (N + 2 V)), exact beyond 64 bits; by long integers where they hold it."""
    size = F.col("words") + 2 * F.col("kept")
    over = F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    short = F.call_function("div", F.lit(UNIT).cast("long") * (n + 2).cast("long"), size.cast("long"))
    return F.lit(1).cast("long") + F.when(n <= LONG_COUNT, short).otherwise(F.call_function("div", over, size.cast("decimal(20,0)")))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(key, rows: pd.DataFrame) -> pd.DataFrame:
    """One block of terms and two tiles of groups: for each pair the sum over the block's terms that a group of the tiles has, and the number of these terms.
    A row without idx says that a group is there."""
    there = rows[rows["idx"].isna()].sort_values("grp")
    rows = rows[rows["idx"].notna()]
    term, cols = np.unique(rows["idx"].to_numpy(np.int64), return_inverse=True)
    who, tiles = there["grp"].to_numpy(np.int64), there["tile"].to_numpy(np.int64)
    p = np.repeat(there["p0"].to_numpy(np.int64)[:, None], len(term), axis=1)
    p[np.searchsorted(who, rows["grp"].to_numpy(np.int64)), cols] = rows["p"].to_numpy(np.int64)
    left, right = np.flatnonzero(tiles == key[3]), np.flatnonzero(tiles == key[4])
    out = []
    for i in left:
        d, s = p[right] - p[i], p[right] + p[i]
        v = (d * d // s).sum(axis=1)
        out += [(key[0], who[i], who[j], int(x), len(term)) for j, x in zip(right, v, strict=True) if key[3] != key[4] or i < j]
    return pd.DataFrame(out, columns=["lang_no", "grp", "other", "value", "terms"])


def _blocks(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """entries: slice, lang_no, grp, idx, p, p0, tile.  Each goes to all pairs of tiles that its own is in; and each group says in each block that it is there, since
    it differs from others also where it has none of their terms."""
    each = entries.withColumn("block", F.floor(F.col("idx") / BLOCK).cast("int")).select("slice", "lang_no", "grp", "idx", "p", "p0", "tile", "block")
    there = groups.join(each.select("slice", "lang_no", "block").distinct(), "lang_no")
    none = F.lit(None)
    each = each.unionByName(there.select("slice", "lang_no", "grp", none.cast("int").alias("idx"), none.cast("long").alias("p"), "p0", "tile", "block"))
    tiles = groups.groupBy("lang_no").agg((F.max("tile") + 1).alias("tiles"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("a"), F.greatest(t, F.col("tile")).alias("b")))
    each = each.join(F.broadcast(tiles), "lang_no").withColumn("x", F.explode(pair))  # a row for each lang, MOST_LANGS at most
    return each.select("slice", "lang_no", "grp", "idx", "p", "p0", "tile", "block", F.col("x.a").alias("a"), F.col("x.b").alias("b"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_df: int = MIN_DF, top: int = TOP, most_terms: int = MOST_TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, part ('pair': all other sources of the lang; 'term': the terms that mark the source), item, value, rank."""
    rows = documents(docs, text, lang, source)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    seen = stored(rows.select("lang", "source").distinct().withColumn("grp", number.cast("int")), "seen")
    made, vocabulary, langs = vectors(rows.join(seen, ["lang", "source"]), min_df, most_terms)
    sums, vocabulary = stored(group_sums(made), "sums"), stored(vocabulary, "vocabulary")

    size = vocabulary.groupBy("lang_no").agg(F.count("*").alias("kept"))
    n = sums.groupBy("lang_no", "grp").agg(F.sum("n").alias("words"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = seen.join(F.broadcast(langs), "lang").join(n, ["lang_no", "grp"], "left").join(size, "lang_no", "left").select("lang_no", "grp", "source", zero("words"), zero("kept"))
    groups = groups.withColumn("p0", F.when(F.col("kept") > 0, _share(F.lit(0)))).withColumn("tile", F.floor(F.col("grp") / tile).cast("int"))
    groups = stored(groups, "groups")
    entries = sums.join(groups, ["lang_no", "grp"]).select("slice", "lang_no", "grp", "idx", _share(F.col("n")).alias("p"), "p0", "tile")

    # pairs: sums over the blocks, and one known number for each term that neither tile has
    part = _blocks(entries, groups).groupBy("lang_no", "slice", "block", "a", "b").applyInPandas(_pair_sums, "lang_no int, grp int, other int, value long, terms long")
    part = part.groupBy("lang_no", "grp", "other").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    g = groups.select("lang_no", "grp", "source", "kept", "p0")
    both = g.join(g.select("lang_no", F.col("grp").alias("other"), F.col("source").alias("item"), F.col("p0").alias("q0")), "lang_no").filter("grp < other")
    both = both.join(part, ["lang_no", "grp", "other"], "left")
    rest = (F.col("kept") - F.coalesce("terms", F.lit(0))) * _apart(F.col("p0"), F.col("q0"))
    both = both.withColumn("value", F.coalesce(F.col("value"), F.lit(0)) + F.when(F.col("kept") > 0, rest).otherwise(0))
    both = both.withColumn("x", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))))
    pairs = both.select("lang_no", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    # terms: a group's share against that of its lang
    whole = sums.groupBy("slice", "lang_no", "idx").agg(F.sum("n").alias("n"))
    lang_n = sums.groupBy("lang_no").agg(F.sum("n").alias("words")).join(size, "lang_no")
    whole = whole.join(F.broadcast(lang_n), "lang_no")  # a row for each lang, MOST_LANGS at most
    whole = whole.select("slice", "lang_no", "idx", _share(F.col("n")).alias("q"))
    marks = entries.join(whole.hint("shuffle_hash"), ["slice", "lang_no", "idx"]).filter("p > q").select("slice", "lang_no", "idx", "grp", _apart(F.col("p"), F.col("q")).alias("value"))
    # by value first, with all that tie, so that few need their term
    best = F.rank().over(Window.partitionBy("lang_no", "grp").orderBy(F.desc("value")))
    marks = marks.withColumn("best", best).filter(F.col("best") <= top).join(vocabulary, ["slice", "lang_no", "idx"])
    marks = marks.join(groups, ["lang_no", "grp"]).select("lang_no", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang_no", "source", "part").orderBy(F.desc("value"), "item")
    marks = marks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = pairs.withColumn("rank", F.row_number().over(order)).unionByName(marks)
    return out.join(F.broadcast(langs), "lang_no").select("lang", "source", "part", "item", "value", "rank")


#: The same for DuckDB.
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS MATERIALIZED (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT k) >= {MIN_DF}),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (
  SELECT g.lang, g.source, v.term, coalesce(x.n, 0) AS n FROM g JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) x USING (lang, source, term)
), p AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + ({UNIT}::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM c
), w AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
q AS (SELECT lang, term, 1 + ({UNIT}::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM w),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), mark AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
both_parts AS (SELECT * FROM pair UNION ALL SELECT * FROM mark)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts) WHERE part = 'pair' OR rank <= {TOP}
"""
