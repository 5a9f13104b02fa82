"""Codes of vectors: product quantisation, nearest entries found in GNATs.

A vector is cut into equal parts; each part is coded by the number of its nearest entry in the codebook of that position.  Entries
stand in a geometric near-neighbour access tree (GNAT): a node has a few split points, every other entry goes below the split point nearest
to it, and for each split point and each child the node keeps the least and greatest distance from the one to what lies under the other.  A query
takes the split points in turn; the distance to one of them and the radius of the best entry so far rule out every child whose range they cannot
reach, with all that lies below it.  Components are integers.  A child is ruled out only when its distances are strictly greater than the radius, with
lower bounds rounded down and upper bounds up, so no entry at the least distance is lost; equal squared distances (integers) go to the lower number.

A round assigns all parts and replaces each entry by the floor of the mean of its parts: tasks send sums for each entry, which Spark adds up.
Trees are made on the driver; the codebooks (ENTRIES entries for each part) are all that travels, whatever the number of vectors.

Defined cases: rows whose vector is null or empty, or holds null or non-finite components, are dropped; a null id is kept, and comes after all others; of repeated ids
all rows count, ordered by vector; with fewer vectors than entries the codebooks have as many entries as there are vectors; ties go to the lower entry; an
empty table gives an empty result; vectors of different lengths, or of a length that is no multiple of the parts, raise an error, and so do components so
large that a squared distance might exceed 64 bits; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Split points of a node; a node of no more entries than LEAF has no ranges.
DEGREE, LEAF = 4, 4
#: Components that a task holds at once.
BLOCK = 1 << 21
NEVER = np.iinfo(np.int64).max


@dataclass
class Node:
    splits: np.ndarray  # numbers of entries
    low: np.ndarray  # [i, j]: least distance of split i to what is under split j, itself included; rounded down
    high: np.ndarray  # the greatest; rounded up
    below: list[Node | None] = field(default_factory=list)


def _down(squared: np.ndarray) -> np.ndarray:
    return np.maximum(np.floor(np.sqrt(squared.astype(np.float64)) * (1 - 2.0**-50)), 0)


def _up(squared: np.ndarray) -> np.ndarray:
    return np.ceil(np.sqrt(squared.astype(np.float64)) * (1 + 2.0**-50))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def gnat(entries: np.ndarray, own: np.ndarray | None = None, degree: int = DEGREE, leaf: int = LEAF) -> Node | None:
    """The tree over the entries (k x d, integers) with the numbers own."""
    own = np.arange(len(entries)) if own is None else own
    if not len(own):
        return None
    if len(own) <= leaf:
        m = len(own)
        return Node(own, np.zeros((m, m)), np.full((m, m), np.inf), [None] * m)
    # split points far from each other: each is the farthest from those before it
    at, far = [0], _squared(entries[own], entries[own[0]])
    while len(at) < degree and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, _squared(entries[own], entries[own[at[-1]]]))
    d2 = np.stack([_squared(entries[own], entries[own[a]]) for a in at])
    nearest = d2.argmin(axis=0)
    nearest[at] = np.arange(len(at))
    m = len(at)
    low, high = np.zeros((m, m)), np.zeros((m, m))
    for j in range(m):
        inside = d2[:, nearest == j]
        low[:, j], high[:, j] = _down(inside.min(axis=1)), _up(inside.max(axis=1))
    rest = np.ones(len(own), bool)
    rest[at] = False
    # one split point: all are equal, and only the lowest number, which it has, can be an answer
    below = [gnat(entries, own[rest & (nearest == j)], degree, leaf) if m > 1 else None for j in range(m)]
    return Node(own[at], low, high, below)


def nearest(tree: Node | None, entries: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest entry of each query and its squared distance, and how many distances were computed.  All queries go through a node together."""
    best, who, work = np.full(len(q), NEVER), np.zeros(len(q), np.int64), 0

    def visit(node: Node | None, at: np.ndarray) -> None:
        nonlocal work
        if node is None or not len(at):
            return
        alive = np.ones((len(at), len(node.splits)), bool)
        for i, s in enumerate(node.splits):
            r = np.flatnonzero(alive[:, i])
            rows = at[r]
            d2 = _squared(q[rows], entries[s])
            work += len(rows)
            better = (d2 < best[rows]) | ((d2 == best[rows]) & (s < who[rows]))
            best[rows[better]], who[rows[better]] = d2[better], s
            radius = _up(best[rows])
            out = ((_down(d2) - radius)[:, None] > node.high[i]) | ((_up(d2) + radius)[:, None] < node.low[i])
            alive[r] &= ~out
        for j, child in enumerate(node.below):
            visit(child, at[alive[:, j]])

    visit(tree, np.arange(len(q)))
    return who, best, work


@dataclass(frozen=True)
class Codebooks:
    entries: np.ndarray  # parts x entries x components of a part, integers
    scale: int = SCALE

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def trees(self) -> list[Node | None]:
        return [gnat(e) for e in self.entries]


def kept_vectors(df: DataFrame, key: str, vector: str, columns: list[str] = ()) -> DataFrame:
    """__id, __vec, and __c0, __c1, ... of other columns: the rows whose vector has components, all of them finite."""
    rows = packed(df, __id=key, __vec=vector, **{f"__c{i}": c for i, c in enumerate(columns)}).drop("__row")
    odd = F.exists("__vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("__vec").isNotNull() & (F.size("__vec") > 0)).filter(~odd)


def _integers(vec: pa.Array, dim: int, scale: int):
    """Blocks (first row, rows x dim) of floor(scale * x)."""
    step = max(1, BLOCK // dim)
    bound = isqrt(NEVER // (4 * dim))
    for a in range(0, len(vec), step):
        part = vec.slice(a, step)
        x = np.floor(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        if len(x) and np.abs(x).max() > bound:
            raise ValueError(f"a component is beyond {bound} / {scale}: squared distances might exceed 64 bits")
        yield a, x.astype(np.int64).reshape(len(part), dim)


def _assigned_sums(entries: np.ndarray, trees: list[Node | None], dim: int, scale: int):
    parts, k, width = entries.shape

    def run(batches):
        sums, n = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            for _, x in _integers(b.column("__vec"), dim, scale):
                x = x.reshape(len(x), parts, width)
                for p in range(parts):
                    who = nearest(trees[p], entries[p], x[:, p])[0]
                    np.add.at(sums[p], who, x[:, p])
                    n[p] += np.bincount(who, minlength=k)
        p, e = np.nonzero(n)
        values = [[int(n[i, j]), *sums[i, j].tolist()] for i, j in zip(p, e, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(values, pa.list_(pa.int64()))], ["part", "entry", "x"])

    return run


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """rows: of kept_vectors, stored.  None where there are no vectors."""
    if not 1 <= entries <= 256:
        raise ValueError("from 1 to 256 entries, two hex digits")
    least, most = rows.agg(F.min(F.size("__vec")), F.max(F.size("__vec"))).first()
    if least is None:
        return None
    if least != most or least % parts:
        raise ValueError(f"vectors have {least} to {most} components; all must have as many, in {parts} equal parts")
    first = rows.orderBy(F.asc_nulls_last("__id"), "__vec").limit(entries).select("__vec").collect()
    x = np.concatenate([b for _, b in _integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), least, scale)])
    books = x.reshape(len(x), parts, least // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        run = _assigned_sums(books, Codebooks(books).trees(), least, scale)
        sums = rows.select("__vec").mapInArrow(run, "part int, entry int, x array<long>").select("part", "entry", F.posexplode("x").alias("at", "x"))
        found = {(r.part, r.entry, r.at): r.x for r in sums.groupBy("part", "entry", "at").agg(F.sum("x").alias("x")).collect()}
        for (p, e, at), v in found.items():
            if at:
                books[p, e, at - 1] = v // found[p, e, 0]
    return Codebooks(books, scale)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """rows without __vec, with code (two hex digits for each part) and error (squared distance to what the code says)."""
    entries, trees, scale = books.entries, books.trees(), books.scale
    parts, _, width = entries.shape
    rest = [c for c in rows.columns if c != "__vec"]

    def run(batches):
        for b in batches:
            codes, errors = [], []
            for _, x in _integers(b.column("__vec"), parts * width, scale):
                x = x.reshape(len(x), parts, width)
                found = [nearest(trees[p], entries[p], x[:, p]) for p in range(parts)]
                codes += [row.tobytes().hex() for row in np.stack([f[0] for f in found], axis=1).astype(np.uint8)]
                errors.append(sum(f[1] for f in found))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(codes, pa.string()), pa.array(np.concatenate(errors) if errors else [], pa.int64())], [*rest, "code", "error"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest)
    return rows.mapInArrow(run, f"{kinds}, code string, error long")


def decode(df: DataFrame, books: Codebooks, code: str = "code", vector: str = "approximate") -> DataFrame:
    """df with the vector that the code stands for."""
    parts, k, _ = books.entries.shape
    table = df.sparkSession.createDataFrame([(p * k + e, (books.entries[p, e] / books.scale).tolist()) for p in range(parts) for e in range(k)], "at int, x array<double>")
    table = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda r: r["x"]).alias("__book"))  # one row of parts x entries
    entry = lambda p: F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int") + p * k
    return df.crossJoin(F.broadcast(table)).withColumn(vector, F.flatten(F.array(*(F.get("__book", entry(p)) for p in range(parts))))).drop("__book")


def coded(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label, code, error, label_error (error summed over rows of equal labels, nulls together) and the codebooks' SHA-256."""
    rows = stored(kept_vectors(df, key, vector, [label]), "vectors")
    books = fit(rows)
    kind, label_kind = rows.schema["__id"].dataType.simpleString(), rows.schema["__c0"].dataType.simpleString()
    if books is None:
        return df.sparkSession.createDataFrame([], f"id {kind}, label {label_kind}, code string, error long, label_error long, codebooks_sha256 string")
    out = stored(encode(rows, books), "codes")
    total = stored(out.groupBy(F.col("__c0").alias("__l")).agg(F.sum("error").alias("label_error")), "labels")
    out = out.join(total, F.col("__c0").eqNullSafe(F.col("__l")))
    return out.select(F.col("__id").alias("id"), F.col("__c0").alias("label"), "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def sql(dim: int) -> str:
    """The same for DuckDB, over vectors of dim components and unique ids."""
    width = dim // PARTS
    lead = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS MATERIALIZED (SELECT vec_id, i // {width} AS part, i % {width} AS pos, v[i + 1] AS x FROM k, range({dim}) r(i)),
e0 AS MATERIALIZED (SELECT part, entry, pos, x FROM c JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id))"""
    for r in range(ROUNDS + 1):
        lead += f""",
a{r} AS MATERIALIZED (
  SELECT vec_id, part, min(d * {ENTRIES} + entry) % {ENTRIES} AS entry, min(d) AS d
  FROM (SELECT vec_id, part, entry, sum((c.x - e.x) * (c.x - e.x))::HUGEINT AS d FROM c JOIN e{r} e USING (part, pos) GROUP BY ALL) GROUP BY ALL
)"""
        if r < ROUNDS:
            lead += f""",
s{r} AS (SELECT part, entry, pos, sum(x)::HUGEINT AS s, count(*) AS n FROM c JOIN a{r} USING (vec_id, part) GROUP BY ALL),
e{r + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, x)::BIGINT AS x FROM e{r} LEFT JOIN s{r} USING (part, entry, pos))"""
    return lead + f""",
t AS (SELECT vec_id, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM e{ROUNDS}) AS codebooks_sha256
FROM t JOIN k USING (vec_id)
"""


SQL = sql(64)
