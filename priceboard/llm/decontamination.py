"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question asked again with other values
has the same template.  Windows of WINDOW template words of documents and benchmark items are
hash-joined; hits of one document and item on one diagonal (same shift) are put together, and the
slots that they cover must be filled consistently: equal values of the item by equal values in the
document, and different names by different ones (numbers may become equal by chance: 3 cows and 5 sheep asked as 6 cows and 6 sheep).  A document is contaminated by an item if consistent (or
literally equal) windows cover LEAST words of it, or all of a shorter item.  Windows are also joined by
their words as they are, so that a copy is found whatever it is made of.

Canonical words: white space separates words; marks around a word go; case goes.  A number is digits
with separators, sign, currency or percent; a unit is a word of UNITS after a number (or glued to
it), and both are one placeholder; a name is a capitalised word, and a run of them without marks between is one
placeholder, so names of one and of two words are alike.  Words of NUMBERS are numbers too.  A word that begins a sentence may be a name, and counts as one
if it is capitalised (so does each German noun: templates then have more slots, which must be filled consistently); since the same word may stand inside a
sentence of a document, or the other way round, items have up to three forms: as they are, with their first word taken the other way, and with no name at the beginning of
a sentence.  Scripts without capitals have no names, so their names are words like others.  A template window needs LITERAL
words that are no placeholders, since a window of placeholders alone says nothing; a literal one needs none, and reads all words.

Before the join, documents are looked up in a bitmap of BITS bits of the benchmark's window hashes:
its size is fixed, and when a benchmark fills it, more windows pass on to the join and none is lost.

Defined cases: a null or empty text has no windows; items of four to seven words are looked for as
one window, items of one to three words, which say little, only word for word and where they are all of a line of a
document; repeated items and documents are rows of their own, and of an item's places in a document (ties) the one with most
words and fewest changes is given; texts of any length are searched whole;
an empty table on either side finds nothing; other columns, whatever their names, pass through unread.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_blocks, mix, packed, small, stored, windows

WINDOW = 8
LITERAL = 4
LEAST = 13
BITS = 1 << 24
MAX_BROADCAST_WINDOWS = 200_000
BLOCK_BYTES = 1_000_000
#: Words that are units when a number is before them.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes"
    " ml cl l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks"
    " month months year years hz khz mhz ghz b kb mb gb tb v w kw kwh j kj cal kcal k c f % percent usd eur gbp dollar dollars euro euros pound pounds cent cents"
    " m/s km/h mph kmh degree degrees".split()
)
#: Number words that are no articles, of the languages read (en, de, fr, es).
NUMBERS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand"
    " zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend"
    " deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille"
    " dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil".split()
)
_UNITS = frozenset(u.encode() for u in UNITS)
_NUMBER = re.compile(rb"[+-]?(?:[$#]|\xe2\x82\xac|\xc2\xa3)?[+-]?\d[\d.,:/]*%?")
_GLUED = re.compile(rb"[+-]?\d[\d.,]*([A-Za-z%/]+)")
_MARKS = b".,;:!?\"'()[]{}<>"
_CLOSING = frozenset(_MARKS[i : i + 1] for i in range(len(_MARKS)))
_LINE = b"\x01"
NUMBER, NAME, UNIT, QUANTITY = 1, 2, 3, 4


class _Lexicon(dict):
    """token -> row of the arrays below; bounded between blocks."""

    LIMIT = 200_000

    def __init__(self):
        super().__init__()
        self.literal, self.flags = [], []

    def __missing__(self, token: bytes) -> int:
        core = token.strip(_MARKS)
        low = core.lower() or token
        # name: one capital (of any script) and no other
        plain = core.isalpha()  # ASCII letters alone: no number
        try:
            word = core.decode()
        except UnicodeDecodeError:
            word = ""
        name = len(word) > 1 and word[0].isupper() and word[1:].islower() and word.isalpha()
        number = (not plain and bool(_NUMBER.fullmatch(core))) or word.lower() in NUMBERS
        name = name and not number
        glued = not plain and not number and bool((m := _GLUED.fullmatch(core)) and m[1].lower().decode() in UNITS)
        unit = low in _UNITS
        ends = token.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?")
        self.literal.append(xxhash.xxh3_64_intdigest(low))
        closes = token[-1:] in _CLOSING
        self.flags.append(number | name << 1 | unit << 2 | glued << 3 | ends << 4 | (token == _LINE) << 5 | closes << 6 | (len(word) > 1 and word.isalpha()) << 7)
        self[token] = n = len(self.literal) - 1
        return n

    def reset(self) -> None:
        if len(self) > self.LIMIT:
            self.clear()
            self.literal, self.flags = [], []


_PLACEHOLDER = np.array([0] + [xxhash.xxh3_64_intdigest(b"\x00slot%d" % i) for i in (NUMBER, NAME, UNIT, QUANTITY)], np.uint64)


class Form(NamedTuple):
    """A sequence of canonical words: hash, slot type, text, line and first and last word as they are."""

    h: np.ndarray
    kind: np.ndarray
    doc: np.ndarray
    line: np.ndarray
    first: np.ndarray
    last: np.ndarray


#: How the beginnings of sentences are taken: as they are written; the text's first word the other way; none of them as a name.
AS_WRITTEN, FIRST_TURNED, NO_NAMES = range(3)


def templates(texts: list[bytes], lex: _Lexicon, how: int = AS_WRITTEN) -> tuple[Form, Form, list[bytes]]:
    """The texts as templates and as they are, and their words."""
    tokens, size = [], []
    for t in texts:
        found = t.replace(b"\n", b" \x01 ").split()
        tokens += found
        size.append(len(found))
    lex.reset()
    at = np.fromiter(map(lex.__getitem__, tokens), np.int64, len(tokens))
    doc = np.repeat(np.arange(len(texts)), size)
    literal, flags = np.array(lex.literal, np.uint64)[at] if len(at) else np.empty(0, np.uint64), np.array(lex.flags, np.uint8)[at] if len(at) else np.empty(0, np.uint8)
    # what is before a word: the end of a sentence, a line's end or the text's begin
    begins = np.ones(len(at), bool)
    begins[1:] = (flags[:-1] & 48 > 0) | (doc[1:] != doc[:-1])
    line = np.cumsum(flags & 32 > 0) + doc  # differs between lines and between texts
    words = np.flatnonzero(flags & 32 == 0)
    literal, flags, doc, begins, line = literal[words], flags[words], doc[words], begins[words], line[words]
    number, kind, every = flags & 1 > 0, np.zeros(len(words), np.int8), np.arange(len(words))
    kind[flags & 2 > 0] = NAME
    kind[flags & 8 > 0] = QUANTITY
    kind[number] = NUMBER
    if how == NO_NAMES:
        kind[begins & (kind == NAME)] = 0
    elif how == FIRST_TURNED:
        first = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)]
        turned = first & (flags & 128 > 0) & ((kind == NAME) | (kind == 0))
        kind[turned] = np.where(kind[turned] == NAME, 0, NAME)
    # words that go with the one before: a unit with its number, a name with a name
    joins = np.zeros(len(words), bool)
    open_before = (flags[:-1] & 64 == 0) & (doc[1:] == doc[:-1])
    joins[1:] = open_before & ((number[:-1] & (flags[1:] & 4 > 0) & ~number[1:]) | ((kind[:-1] == NAME) & (kind[1:] == NAME) & ~begins[1:]))
    kind[np.flatnonzero(joins & (flags & 4 > 0) & (kind != NAME)) - 1] = QUANTITY
    heads = np.flatnonzero(~joins)
    last = np.append(heads[1:], len(words)) - 1
    template = Form(np.where(kind[heads] == 0, literal[heads], _PLACEHOLDER[kind[heads]]), kind[heads], doc[heads], line[heads], heads, last)
    return template, Form(literal, kind, doc, line, every, every), [tokens[i] for i in words]


def _alike(a: Form, b: Form, d: int) -> bool:
    """Whether two forms of text d are the same."""
    return np.array_equal(a.h[a.doc == d], b.h[b.doc == d])


_SLOTS = pa.list_(pa.struct([("off", pa.int32()), ("value", pa.string()), ("name", pa.bool_())]))


def _found(ids: pa.Array, texts: list[bytes], lex: _Lexicon, lengths: list[int], bits: np.ndarray | None, whole: bool):
    """Windows as record batches: id, pos, h, words (of the text), len, slots, exact (h is of the words as they are; slots
    are of items only).  whole: items, of which one shorter than WINDOW is taken whole."""
    *forms, tokens = templates(texts, lex)
    forms = [(exact, AS_WRITTEN, form, None) for exact, form in enumerate(forms)]
    for how in (FIRST_TURNED, NO_NAMES) if whole else ():
        other = templates(texts, lex, how)[0]
        forms.append((0, how, other, [not _alike(forms[0][2], other, d) for d in range(len(texts))]))
    for exact, how, form, new in forms:
        size = np.bincount(form.doc, minlength=len(texts)) if len(form.doc) else np.zeros(len(texts), np.int64)
        start = np.cumsum(size) - size
        filled = np.concatenate([[0], np.cumsum(form.kind != 0)])
        for n in lengths:
            k = len(form.h) - n + 1
            if k < 1 or (n < LITERAL and not exact):
                continue
            w = mix(windows(form.h, n) + np.uint64(n + (exact << 8)))
            ok = form.doc[:k] == form.doc[n - 1 :]
            if whole and n < WINDOW:
                ok &= size[form.doc[:k]] == n
            elif n < LITERAL:  # all of a line
                edge = np.concatenate([[True], form.line[1:] != form.line[:-1], [True]])
                ok &= (form.line[:k] == form.line[n - 1 :]) & edge[:k] & edge[n : n + k]
            if new is not None:
                ok &= np.array(new)[form.doc[:k]]
            if not exact:
                ok &= n - (filled[n:] - filled[:-n]) >= min(LITERAL, n)
            if bits is not None:
                b = w >> np.uint64(64 - BITS.bit_length() + 1)
                ok &= (bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 > 0
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            value = lambda j: b" ".join(x.strip(_MARKS).lower() for x in tokens[form.first[j] : form.last[j] + 1]).decode("utf-8", "replace")  # noqa: E731, B023
            slots = [[] if exact and not whole else [{"off": int(j), "value": value(i + j), "name": bool(form.kind[i + j] == NAME)} for j in np.flatnonzero(form.kind[i : i + n])] for i in at]
            d = form.doc[at]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(d)), pa.array((at - start[d]).astype(np.int32)), pa.array(w[at].view(np.int64)), pa.array(size[d].astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(slots, _SLOTS), pa.array(np.full(len(at), exact > 0)), pa.array(np.full(len(at), how, np.int32))],
                names=["id", "pos", "h", "words", "len", "slots", "exact", "how"],
            )


def _windows(df: DataFrame, lengths: list[int], bits=None, whole: bool = False) -> DataFrame:
    """df: id, text (bytes)."""

    def run(batches):
        lex, mask = _Lexicon(), bits.value if bits is not None else None
        for batch in batches:
            for a, b in byte_blocks(batch.column(1), BLOCK_BYTES):
                yield from _found(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).to_pylist(), lex, lengths, mask, whole)

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, pos int, h bigint, words int, len int, slots array<struct<off:int,value:string,name:boolean>>, exact boolean, how int")


def _covered(places, length: int = WINDOW):
    """Words that windows at these places cover."""
    fold = F.aggregate(
        F.array_sort(places), F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct(F.greatest(a["end"], p["pos"] + p["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), p["pos"] + p["len"] - F.greatest(p["pos"], a["end"]))).alias("n")),
    )
    return fold["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """__key, id, item, covered, item_words, slots, changed, verbatim: a row for each document and item that contaminates it."""
    spark = docs.sparkSession
    rows = _keyed(docs, key, text)
    items = packed(benchmark, __id=item, __text=item_text).select(F.struct(F.xxhash64("__text").alias("k"), F.col("__id").alias("item")).alias("id"), F.col("__text").cast("binary").alias("text"))
    lengths = list(range(1, WINDOW + 1))
    bench = stored(_windows(items.filter("text is not null"), lengths, whole=True).filter((F.col("len") == WINDOW) | (F.col("len") == F.col("words"))), "items")
    bit = F.shiftrightunsigned("h", 64 - BITS.bit_length() + 1).alias("b")
    marked = np.zeros(BITS // 8, np.uint8)
    found = bench.select(bit).distinct().toPandas()["b"].to_numpy()  # BITS values at most
    np.bitwise_or.at(marked, found >> 3, np.uint8(1) << (found & 7).astype(np.uint8))
    used = sorted(r["len"] for r in bench.select("len").distinct().collect()) or [WINDOW]  # 1..WINDOW
    texts = rows.filter("__text is not null").select(F.struct(F.col("__key").alias("key"), F.col("__id").alias("id")).alias("id"), F.col("__text").cast("binary").alias("text"))
    hits = _windows(texts, used, spark.sparkContext.broadcast(marked))
    few = small(bench, MAX_BROADCAST_WINDOWS)
    b = bench.select("h", F.col("len").alias("blen"), F.col("pos").alias("bpos"), F.col("id").alias("item"), F.col("words").alias("item_words"), F.col("slots").alias("bslots"), F.col("exact").alias("bexact"), "how")
    hits = hits.select(F.col("id").alias("doc"), "pos", "h", "len", "slots", "exact")
    joined = hits.join(F.broadcast(b) if few else b, "h").filter("len = blen and exact = bexact")
    pair = F.zip_with("bslots", "slots", lambda x, y: F.struct((F.col("bpos") + x["off"]).alias("at"), x["value"].alias("a"), y["value"].alias("b"), x["name"].alias("name")))
    kept = F.transform("bslots", lambda x: F.struct((F.col("bpos") + x["off"]).alias("at"), x["value"].alias("a"), x["value"].alias("b"), x["name"].alias("name")))
    joined = joined.withColumn("pairs", F.when(F.col("exact"), kept).otherwise(pair)).withColumn("same", F.forall("pairs", lambda p: p["a"] == p["b"]))
    place = F.struct(F.col("bpos").alias("pos"), "len")
    runs = joined.groupBy("doc", "item", "exact", "how", "item_words", (F.col("pos") - F.col("bpos")).alias("shift")).agg(
        F.collect_set(place).alias("places"), F.collect_set(F.when(F.col("same"), place)).alias("equal"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs")
    )
    # each of the item's values has one value in the document, and different names have different ones
    n_of = lambda p, *cols: F.size(F.array_distinct(F.transform(p, lambda x: F.struct(*(x[c].alias(c) for c in cols)))))
    names = F.filter("pairs", lambda p: p["name"])
    firm = (n_of(F.col("pairs"), "a", "b") == n_of(F.col("pairs"), "a")) & (n_of(names, "a", "b") == n_of(names, "b"))
    runs = runs.withColumn("covered", F.greatest(F.when(firm, _covered(F.col("places"))).otherwise(F.lit(0)), _covered(F.col("equal"))))
    runs = runs.filter(F.col("covered") >= F.least(F.lit(least), F.col("item_words")))
    changed = F.size(F.filter("pairs", lambda p: p["a"] != p["b"]))
    runs = runs.select("doc", F.col("item.item").alias("item"), "covered", "item_words", F.size("pairs").alias("slots"), changed.alias("changed"))
    best = runs.groupBy("doc", "item").agg(F.max(F.struct("covered", F.negative("changed").alias("unchanged"), "slots", "item_words")).alias("r"))
    return best.select(
        F.col("doc.key").alias("__key"), F.col("doc.id").alias("id"), "item", F.col("r.covered").alias("covered"), F.col("r.item_words").alias("item_words"),
        F.col("r.slots").alias("slots"), F.negative("r.unchanged").alias("changed"), (F.col("r.unchanged") == 0).alias("verbatim"),
    )


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """__key: a number of the row by its id and text, the same for repeated rows (whose verdicts are equal)."""
    return packed(docs, __id=key, __text=text).withColumn("__key", F.concat_ws("/", F.col("__id").cast("string"), F.md5(F.coalesce(F.col("__text"), F.lit("")).cast("binary"))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that no item contaminates, with docs' own columns."""
    bad = stored(contamination(docs, benchmark, key, text, **how).select("__key").distinct(), "leaks")
    few = small(bad, MAX_BROADCAST_WINDOWS)
    return _keyed(docs, key, text).join(F.broadcast(bad) if few else bad, "__key", "left_anti").select("__row.*")
