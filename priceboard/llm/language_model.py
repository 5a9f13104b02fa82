"""Language-model scores from a sharded Elias-Fano trie of word pairs.

Tokens are the words of a text (A-Z lower-cased) and one end.  With c the counts of the training texts, N
their tokens and V their distinct tokens, the lower model is p(w) = (c(w) + 1) / (N + V + 1), which
leaves one share to unknown words, and the pair model adds it to the counts as a prior:

    p(w | v) = (c(v w) + m(v) p(w)) / (c(v) + m(v)),   m(v) = PRIOR * max(c(v), N / 2**16)

which sums to one over w.  The context of a text's first word is the end of another.

The trie is kept the other way round, words first and their contexts below, and is sharded by word; then
everything a token needs but m(v) is in its shard: log p(w | v) is the sum of log(p(w) + c(v w) / m(v)), the
smoothed probability that the trie holds, and of log(m(v) / (c(v) + m(v))), which depends on v alone,
so it is added where v itself is the word.  Words with 2**-16 of all tokens or more (2**16 words at
most: a proven bound) have their counts broadcast and are spread over all shards by context, so that
no word's tokens meet in one task; the others have m(v) = PRIOR * N / 2**16.

A shard's levels: its words, sorted, as Elias-Fano; monotone pointers to their contexts and
running counts, as Elias-Fano; the contexts of each word as numbers in the shard's list of
contexts, put in one monotone sequence (word * contexts + context), as Elias-Fano, searched for the
successor within the word's range; and the pair's smoothed probability, quantised to 256 levels of its logarithm.

Documents travel once: a task packs its texts' pairs by shard (words, contexts, documents as short
arrays), a shard builds its levels from the training part, looks up all pairs, and returns sums by
document.  Tokens are spread by hash, so a shard holds SHARD_TOKENS of them, whatever the size of the corpus.

Defined cases: a null text counts as empty (one token, the end); a null key is training; an empty table gives an
empty result; repeated rows (ties) count as often as they come, and a text of any length is read whole; without training texts N = V = 0 and every
token has probability 1; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, byte_blocks, mix, packed, stored
from .elias_fano import EliasFano, mapped

HELD_OUT = (7, 2)
PRIOR = 0.4
HOT = 1 << 16
#: Shards at least: enough for the cores of a small cluster.
SHARDS = 32
#: Tokens of a shard and of what a task packs at once.
SHARD_TOKENS = 4_000_000
PACK_TOKENS = 3_000_000
BLOCK_BYTES = 2_000_000
#: Bytes of text for each shard that counts words.
COUNT_BYTES = 64_000_000
END = b"\n"
_U = np.uint64


def _dump(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(a.tobytes() for a in arrays)]))


def _load(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    for char, length in head.reshape(n, 2).tolist():
        out.append(np.frombuffer(raw, np.dtype(chr(char)), length, at))
        at += out[-1].nbytes
    return out


def _rows(docs: DataFrame, key: str, text: str, held_out: tuple[int, int]) -> DataFrame:
    """id, text (bytes), held (its key's crc32 leaves that remainder)."""
    rows = packed(docs, __id=key, __text=text)
    held = F.crc32(F.col("__id").cast("string").cast("binary")) % held_out[0] == held_out[1]
    return rows.select(F.col("__id").alias("id"), F.coalesce("__text", F.lit("")).cast("binary").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))


def _packs(batches):
    """(ids, held, tokens of each text, token hashes) for PACK_TOKENS tokens at a time."""
    words = WordHash()
    ids, held, sizes, hashes, n = [], [], [], [], 0

    def out():
        return pa.concat_arrays(ids), np.concatenate(held), np.concatenate(sizes), np.concatenate(hashes)

    for batch in batches:
        flags = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for a, b in byte_blocks(batch.column(1), BLOCK_BYTES):
            tokens, length = [], []
            for t in batch.column(1).slice(a, b - a).to_pylist():
                found = t.lower().split()
                tokens += found
                tokens.append(END)
                length.append(len(found) + 1)
            ids.append(batch.column(0).slice(a, b - a))
            held.append(flags[a:b])
            sizes.append(np.array(length, np.int64))
            hashes.append(words.of(tokens))
            n += len(tokens)
            if n >= PACK_TOKENS:
                yield out()
                ids, held, sizes, hashes, n = [], [], [], [], 0
    if n:
        yield out()


def _count(batches, shards: int):
    for _, held, sizes, h in _packs(batches):
        train = np.repeat(~held, sizes)
        w, c = np.unique(h[train], return_counts=True)
        shard = (mix(w) % _U(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        w, c, edges = w[order], c[order].astype(np.uint32), np.searchsorted(shard[order], np.arange(shards + 1))
        full = np.flatnonzero(np.diff(edges))
        blobs = [_dump(w[edges[s] : edges[s + 1]], c[edges[s] : edges[s + 1]]) for s in full]
        total = np.zeros(len(full) + 1, np.int64)
        total[-1] = len(h)
        yield pa.RecordBatch.from_arrays([pa.array([*full.tolist(), 0]), pa.array([*blobs, _dump(w[:0], c[:0])], pa.binary()), pa.array(total)], ["shard", "blob", "tokens"])


def _counted(t: pa.Table) -> pa.Table:
    parts = [_load(b) for b in t.column("blob").to_pylist()]
    w, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    w, at = np.unique(w, return_inverse=True)
    c = np.bincount(at, c, len(w)).astype(np.int64)
    # hot words of the corpus are among those that are hot in their shard, of which there are HOT at most
    top = np.flatnonzero(c * HOT >= c.sum())
    tokens = int(np.sum(t.column("tokens").to_numpy()))
    lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (w[top].view(np.int64), c[top])]
    return pa.Table.from_arrays([pa.array([int(c.sum())]), pa.array([len(w)]), pa.array([tokens]), *lists], ["n", "v", "tokens", "word", "count"])


def level_one(rows: DataFrame) -> tuple[int, int, int, dict[int, int]]:
    """N, V, all tokens, and the hot words' counts."""
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(SHARDS, -(-size // COUNT_BYTES))
    parts = rows.mapInArrow(lambda b: _count(b, shards), "shard long, blob binary, tokens long")
    parts = stored(parts.groupBy("shard").applyInArrow(_counted, "n long, v long, tokens long, word array<long>, count array<long>"), "level1")
    n, v, tokens = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    hot = F.filter(F.arrays_zip("word", "count"), lambda x: x["count"] * HOT >= max(n, 1))
    pairs = parts.select(F.explode(hot).alias("x")).select("x.word", "x.count")
    return n, v, tokens, {int(r["word"]) & (2**64 - 1): r["count"] for r in pairs.collect()}  # HOT rows at most


def _hot_index(hot: tuple[np.ndarray, np.ndarray], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hot[0]):
        return np.zeros(len(w), np.int64), np.zeros(len(w), bool)
    at = np.minimum(np.searchsorted(hot[0], w), len(hot[0]) - 1)
    return at, hot[0][at] == w


def _spread(batches, shards: int, hot, kind):
    """Rows (shard, pack, ids, blob): a pack's pairs by shard; shards below zero carry the pack's documents."""
    part, k = TaskContext.get().partitionId(), 0
    for ids, held, sizes, h in _packs(batches):
        pack, k = f"{part}-{k}", k + 1
        doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        before = np.empty_like(h)  # the context: the word before, or the end that begins a text
        before[1:] = h[:-1]
        before[:1] = h[-1:]
        _, is_hot = _hot_index(hot, h)
        shard = (mix(np.where(is_hot, h + mix(before), h)) % _U(shards)).astype(np.int64)
        order = np.lexsort((before, h, shard))
        shard, h, before, doc = shard[order], h[order], before[order], doc[order]
        edges = np.searchsorted(shard, np.arange(shards + 1))
        # first rows: the pack's documents
        out = [(-1 - zlib.crc32(pack.encode()) % shards, pack, ids, held, sizes, None)]
        for s in np.flatnonzero(np.diff(edges)):
            a, b = edges[s], edges[s + 1]
            hw, bw, d = h[a:b], before[a:b], doc[a:b]
            new = np.ones(b - a, bool)
            new[1:] = (hw[1:] != hw[:-1]) | (bw[1:] != bw[:-1])
            first = np.flatnonzero(new)
            word, n_below = np.unique(hw[first], return_counts=True)
            context, at = np.unique(bw[first], return_inverse=True)
            times = np.diff(np.append(first, b - a))
            train = np.add.reduceat(~held[d], first, dtype=np.int64)
            blob = _dump(word, n_below.astype(np.uint32), context, at.astype(np.uint32), times.astype(np.uint32), train.astype(np.uint32), d)
            out.append((int(s), pack, None, None, None, blob))
        for s, p, i, hd, sz, blob in out:
            own = i is not None
            id_col = pa.ListArray.from_arrays(pa.array([0, len(i)], pa.int32()), i) if own else pa.array([None], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array([s]), pa.array([p]), id_col, pa.array([hd.tolist() if own else None], pa.list_(pa.bool_())), pa.array([sz.tolist() if own else None], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                names=["shard", "pack", "ids", "held", "sizes", "blob"],
            )


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each number, the 256 numbers that codes stand for): even steps."""
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(256)
    low, step = values.min(), max(np.ptp(values) / 255, 1e-12)
    return np.rint((values - low) / step).astype(np.uint8), low + step * np.arange(256)


def levels(word: np.ndarray, context: np.ndarray, count: np.ndarray, smoothed: Callable, totals: np.ndarray | None = None) -> dict:
    """The trie of pairs (distinct, sorted by word and context; counts above zero).  totals: c of each distinct word; smoothed: log10
    probabilities of pairs by their counts, the totals of their words, their contexts, and which of these each has."""
    words, starts = np.unique(word, return_index=True)
    if totals is None:
        totals = np.add.reduceat(count, starts) if len(words) else count[:0]
    contexts, at = np.unique(context, return_inverse=True)
    owner = np.repeat(np.arange(len(words), dtype=np.int64), np.diff(np.append(starts, len(word))))
    flat = owner.astype(_U) * _U(max(1, len(contexts))) + at.astype(_U)
    codes, book = quantised(smoothed(count, totals[owner], contexts, at))
    sums = np.cumsum(totals)
    ends = np.append(starts[1:], len(word)) if len(words) else starts
    parts = {
        "words": EliasFano.of(words, 2**64 - 1), "contexts": EliasFano.of(contexts, 2**64 - 1), "pointers": EliasFano.of(ends.astype(_U), len(word)),
        "counts": EliasFano.of(sums.astype(_U), int(sums[-1]) if len(sums) else 0), "pairs": EliasFano.of(flat, max(1, len(words) * max(1, len(contexts)))),
    }
    return {"sequences": parts, "codes": codes, "book": book}


def opened(model: dict) -> dict:
    """The same trie over a memory-mapped file."""
    parts, names = model["sequences"], list(model["sequences"])
    arrays = mapped([x for k in names for x in (parts[k].low, parts[k].high, parts[k].ones)] + [model["codes"]])
    again = {k: EliasFano(*arrays[3 * i : 3 * i + 3], parts[k].n, parts[k].width) for i, k in enumerate(names)}
    return {"sequences": again, "codes": arrays[-1], "book": model["book"]}


def looked_up(model: dict, word: np.ndarray, context: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word: distinct; context[i] belongs to word[owner[i]].  c of each word (0: unknown), and for each pair its smoothed log10
    probability but for its context's own part, nan where the pair was not seen."""
    s = model["sequences"]
    at, known = s["words"].find(word)
    safe = np.where(known, at, 0)
    upto, before = np.zeros(len(word), _U), np.zeros(len(word), _U)
    if s["counts"].n:
        upto[known] = s["counts"].get(safe[known])
        later = known & (safe > 0)
        before[later] = s["counts"].get(safe[later] - 1)
    c = (upto - before).astype(np.int64)
    distinct, back = np.unique(context, return_inverse=True)
    number, met = s["contexts"].find(distinct)
    try_ = np.flatnonzero(known[owner] & met[back])
    value = safe[owner[try_]].astype(_U) * _U(max(1, s["contexts"].n)) + number[back[try_]].astype(_U)
    place, hit = s["pairs"].find(value)
    logs = np.full(len(owner), np.nan)
    logs[try_[hit]] = model["book"][model["codes"][place[hit]]]
    return c, logs


def _scored(t: pa.Table, n: int, v: int, hot, kind) -> pa.Table:
    schema = pa.schema([("pack", pa.string()), ("ids", pa.list_(kind)), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("blob", pa.binary())])
    if t.column("shard")[0].as_py() < 0:
        return t.select(schema.names).cast(schema)
    packs, parts = t.column("pack").to_pylist(), [_load(b) for b in t.column("blob").to_pylist()]
    # pairs of the training texts, summed over packs
    word = np.concatenate([np.repeat(p[0], p[1])[p[5] > 0] for p in parts])
    context = np.concatenate([p[2][p[3]][p[5] > 0] for p in parts])
    count = np.concatenate([p[5][p[5] > 0] for p in parts]).astype(np.int64)
    order = np.lexsort((context, word))
    word, context, count = word[order], context[order], count[order]
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])]))
        word, context, count = word[first], context[first], np.add.reduceat(count, first)
    del order
    words, starts = np.unique(word, return_index=True)
    totals = np.add.reduceat(count, starts) if len(words) else count[:0]
    i, is_hot = _hot_index(hot, words)
    if is_hot.any():
        totals[is_hot] = hot[1][i[is_hot]]
    floor, out = PRIOR * n / HOT if n else 1.0, []

    def prior(contexts):
        i, is_hot = _hot_index(hot, contexts)
        return np.where(is_hot, np.maximum(floor, PRIOR * hot[1][i]), floor) if len(hot[0]) else np.full(len(contexts), floor)

    def smoothed(count, total, contexts, at):
        return np.log10((total + 1.0) / (n + v + 1.0) + count / prior(contexts)[at])

    trie = opened(levels(word, context, count, smoothed, totals))
    del word, context, count
    for w, below, ctx, at, times, _, docs in parts:
        owner = np.repeat(np.arange(len(w)), below)
        c, logs = looked_up(trie, w, ctx[at], owner)
        i, is_hot = _hot_index(hot, w)
        if is_hot.any():  # a spread word counts as known in shards that saw none of its pairs
            c = np.where(is_hot, hot[1][i], c)
        base = np.log10((c + 1.0) / (n + v + 1.0))
        own = np.where(is_hot, np.maximum(floor, PRIOR * c), floor)
        per_pair = np.where(np.isnan(logs), base[owner], logs) + np.log10(own / (c + own))[owner]
        size = int(docs.max()) + 1
        seen = np.repeat(np.arange(len(owner)), times)
        score, lower = np.bincount(docs, per_pair[seen], size), np.bincount(docs, base[owner][seen], size)
        known = np.bincount(docs, (c > 0)[owner][seen], size)
        used = np.flatnonzero(np.bincount(docs, minlength=size))
        out.append(_dump(used.astype(np.uint32), score[used], lower[used], known[used].astype(np.uint32)))
    return pa.Table.from_arrays([pa.array(packs), *(pa.nulls(len(packs), schema.field(k).type) for k in ("ids", "held", "sizes")), pa.array(out, pa.binary())], schema=schema)


def _summed(t: pa.Table, n: int, schema: pa.Schema) -> pa.Table:
    own = next(i for i, x in enumerate(t.column("ids").to_pylist()) if x is not None)
    ids, held, sizes = (t.column(k).chunk(0) if t.column(k).num_chunks == 1 else t.column(k).combine_chunks() for k in ("ids", "held", "sizes"))
    ids, held, sizes = ids[own].values, held[own].values, sizes[own].values
    score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for b in t.column("blob").to_pylist():
        if b is not None:
            d, s, low, k = _load(b)
            score[d] += s
            base[d] += low
            known[d] += k
    return pa.Table.from_arrays([ids, held, sizes, pa.array(known), pa.array(np.full(len(ids), n)), pa.array(base), pa.array(score)], schema=schema)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score: learned from the texts that are not held out."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = _rows(docs, key, text, held_out)
    n, v, tokens, hot = level_one(rows)
    shards = max(SHARDS, -(-tokens // SHARD_TOKENS))
    by_word = np.array(sorted(hot), _U)
    table = docs.sparkSession.sparkContext.broadcast((by_word, np.array([hot[int(w)] for w in by_word], np.int64)))
    kind_sql, kind = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    spread = rows.mapInArrow(lambda b: _spread(b, shards, table.value, kind), f"shard long, pack string, ids array<{kind_sql}>, held array<boolean>, sizes array<long>, blob binary")
    sums = spread.groupBy("shard").applyInArrow(lambda t: _scored(t, n, v, table.value, kind), f"pack string, ids array<{kind_sql}>, held array<boolean>, sizes array<long>, blob binary")
    schema = pa.schema([("id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    out = sums.groupBy("pack").applyInArrow(lambda t: _summed(t, n, schema), f"id {kind_sql}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", key)
