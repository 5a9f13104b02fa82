"""What the extractors read of a page: its tokens, the numbers among them, tables, and members and objects of its JSON.

A text is cut into numbers, words and single marks, once.  In the canonical form of a token case is gone, and words that
mean the same are one: a currency is ₹, a karat unit K, a gram unit G, 'per' is /, and a number is # (the mark # itself is a word).  Each number is then a
struct of its place, text, value, unit, the EARLIER canonical tokens before it and the LATER ones after it, both joined by spaces, so
that a rule about a price is a few comparisons of neighbours instead of an expression over the text.  What a number is next to is said by
tokens; how far apart things are is counted in characters of the visible text: start and end of the number in it (prefix sums of the lengths of
numbers and of what lies between), the text since the number before (gap) and up to the next one (then), and the SAID characters before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

NUMBER = r"\d[\d,]*(?:\.\d+)?"
TOKEN = NUMBER + r"|[A-Za-z]+|[^\sA-Za-z\d]"
EARLIER, LATER = 16, 6
#: Characters kept before a number: a label of 33, a currency and marks, and the 60 before the label that may advertise.
SAID, ADVERTISED = 120, 60
CURRENCY = r"(?:₹|(?i:rs\.?|inr))"
#: Words of one meaning.
MEANINGS = {
    "₹": ["rs", "inr"], "K": ["k", "kt", "karat", "carat", "ct"], "G": ["g", "gm", "gms", "gram", "grams"], "/": ["per"],
}
#: What an advertised reduction says.
PROMO_WORDS = ["discount", "coupon", "offer", "save"]


@dataclass
class Page:
    """Columns of a page, each made once: html, its visible text, tokens, their canonical form, numbers, JSON members."""

    html: Column
    text: Column
    tokens: Column
    canon: Column
    numbers: Column
    members: Column


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def canonical(tokens: Column) -> Column:
    meaning = F.create_map(*(F.lit(x) for to, words in MEANINGS.items() for w in words for x in (w, to)))

    def one(t):
        low = F.lower(t)
        return F.when(F.substring(t, 1, 1).between("0", "9"), F.lit("#")).when(t == "#", F.lit("hash")).otherwise(F.coalesce(F.try_element_at(meaning, low), low))

    return F.transform(tokens, one)


def numbers(text: Column, tokens: Column, canon: Column, said: bool = True) -> Column:
    """array<struct<at, s, v, digits, unit, pre, post, said, start, end, gap, then>>; without said where no rule reads it."""
    text = F.coalesce(text, F.lit(""))
    every = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    places = F.filter(every, lambda i: F.get(canon, i) == "#")

    def before(of, i, n):
        start = F.greatest(i - n, F.lit(0))
        return F.array_join(F.slice(of, start + 1, i - start), " ")

    def one(i, j, x):
        s, gap, end = F.get(tokens, i), F.get(x["between"], j), F.get(x["ends"], j)
        first = F.greatest(j - SAID // 2, F.lit(0))  # a piece has two characters or more, but for the first one
        until = [F.right(F.concat(F.array_join(F.slice(x["pieces"], first + 1, j - first), ""), gap), F.lit(SAID)).alias("said")] if said else []
        return F.struct(
            i.alias("at"), s.alias("s"), S.parse_amount(s).alias("v"), F.length(F.replace(F.substring_index(s, ".", 1), F.lit(","), F.lit(""))).alias("digits"), F.lower(F.get(tokens, i + 1)).alias("unit"),
            before(canon, i, EARLIER).alias("pre"), F.array_join(F.slice(canon, i + 2, LATER), " ").alias("post"), *until,
            (end - F.length(s)).alias("start"), end.alias("end"), gap.alias("gap"), F.get(x["between"], j + 1).alias("then"),
        )

    # a piece is what lies between and the number after it; ends are their running lengths.  The text is cut once, and so are the pieces
    cut = F.struct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)).alias("found"), F.split(text, NUMBER).alias("between"))
    both = lambda x: F.struct(x["between"].alias("between"), F.zip_with(F.slice(x["between"], 1, F.size(x["found"])), x["found"], lambda g, s: F.concat(g, s)).alias("pieces"))
    sums = lambda of: F.aggregate(of, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("ends")), lambda a, p: F.struct((a["n"] + F.length(p)).alias("n"), F.concat(a["ends"], F.array(a["n"] + F.length(p))).alias("ends")))
    made = S.once(S.once(cut, both), lambda x: F.struct(places.alias("places"), x["between"].alias("between"), x["pieces"].alias("pieces"), sums(x["pieces"])["ends"].alias("ends")))
    return S.once(made, lambda x: F.transform(x["places"], lambda i, j: one(i, j, x)))


def members(html: Column) -> Column:
    """array<struct<key, value>>: every "key": value of the page's JSON with a plain value, whatever holds it."""
    pair = r'"([^"\\]+)"\s*:\s*("[^"]*"|-?[\d.]+|null)'
    keys, values = (F.regexp_extract_all(html, F.lit(pair), F.lit(g)) for g in (1, 2))
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), F.trim(v, F.lit('"')).alias("value")))


def read(pages: DataFrame, html: str = "html", drop_scripts: bool = True, said: bool = True) -> tuple[DataFrame, Page]:
    """pages with the columns of Page, and these columns; said: whether a rule reads what is said before a number."""
    p = pages.withColumns({"__t": S.visible_text(F.col(html), drop_scripts), "__m": members(F.col(html))})
    p = p.withColumn("__tokens", tokens(F.col("__t"))).withColumn("__canon", canonical(F.col("__tokens")))
    p = p.withColumn("__numbers", numbers(F.col("__t"), F.col("__tokens"), F.col("__canon"), said))
    return p, Page(F.col(html), *(F.col(c) for c in ("__t", "__tokens", "__canon", "__numbers", "__m")))


def objects(text: Column, kind: str = "map<string,string>") -> Column:
    """The innermost JSON objects of a text, as maps."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda x: F.from_json(x, kind)), lambda m: m.isNotNull())


def unescaped(html: Column) -> Column:
    """JSON that stands in a string of JSON, as JSON."""
    return F.replace(html, F.lit('\\"'), F.lit('"'))


def member(page: Page, *keys: str) -> Column:
    """The value of the first member with one of these keys (case is not looked at)."""
    return F.get(F.filter(page.members, lambda m: F.lower(m["key"]).isin(*keys)), F.lit(0))["value"]


def loose_member(html: Column, *keys: str) -> Column:
    """The number after the first of these keys as scripts write them: quoted or not, with a colon, quotes and spaces between (four characters at most)."""
    return S.once(F.regexp_extract(html, r"(?i)\b(?:" + "|".join(keys) + r")['\"\s:]{1,4}([0-9.]+)", 1), lambda v: F.nullif(v, F.lit("")))


def amount(text: Column) -> Column:
    """A text that is an amount and no more: a currency may be before it."""
    return S.parse_amount(F.trim(F.regexp_replace(F.trim(text), r"^(?:₹|\\u20b9|(?i:rs|inr))\.?", "")))


def table_rows(html: Column) -> Column:
    """array<array<string>>: the texts of the cells of each table row."""
    row = lambda x: F.transform(F.slice(F.split(F.substring_index(x, "</tr", 1), r"(?i)<t[dh](?=[\s>])"), 2, 1 << 30), lambda c: S.visible_text(F.concat(F.lit("<td"), c), False))
    return F.transform(F.slice(F.split(F.replace(html, F.lit("</TR"), F.lit("</tr")), r"(?i)<tr(?=[\s>])"), 2, 1 << 30), row)


def marked(number: Column) -> Column:
    """Whether a currency stands right before a number."""
    return number["pre"].endswith("₹") | number["pre"].endswith("₹ .")


def promotional(text: Column) -> Column:
    """Whether a text advertises a reduction."""

    def one(said):
        def of_low(low):
            words = F.transform(F.split(low, " "), lambda w: F.rtrim(w, F.lit("s")))
            return F.arrays_overlap(words, F.array(*map(F.lit, PROMO_WORDS))) | F.contains(low, F.lit("% off")) | F.contains(low, F.lit("off on"))

        return S.once(F.lower(said), of_low) | said.rlike(r"(?:^| )[Uu]se [A-Z]{4,}")

    return S.once(F.array_join(tokens(text), " "), one)


def advertised(said: Column, label: Column) -> Column:
    """Whether the label, or the ADVERTISED characters before it, advertise a reduction.  said: the text up to a number, which ends with the label."""
    before = F.left(said, F.greatest(F.length(said) - F.length(label), F.lit(0)))
    return promotional(F.right(before, F.lit(ADVERTISED))) | promotional(label)


def length_without(text: Column, *parts: str) -> Column:
    """Characters of a text without what the patterns match."""
    for p in parts:
        text = F.regexp_replace(text, p, "")
    return F.length(text)
