"""Surrogates for personal data: keyed, type-consistent replacements that keep format, gender and script.

Entities (e-mail, phone, card, IPv4, social-security and bank numbers, secrets, titled or listed
names) are found by one pattern, in one pass that also clears texts without any.  Each distinct value of
a type gets a surrogate from a keyed hash (HMAC-SHA-256 of a secret that the caller gives): digits become digits and letters letters in the value's
own layout; an e-mail keeps its top domain, a phone its country code, a secret its prefix, a card its first
digit and a right check digit, a bank number its country and right check digits, an address part stays under 256; so
each surrogate is found again as its type.  A name is replaced word by word: a first name by one of the same gender and
script (of neither gender where title and first name tell none), a last name by one
of the same script, so a name and its short form stay together.  Further whole words of a text that
are words of a name found in it get the same surrogates.

Equal values have equal surrogates everywhere (coreference).  Where two values of a type would share
a surrogate, or a surrogate is itself a value of the data, all but the least value are drawn again
with the next attempt number until no collision is left (distinctness).  A name grows with each attempt, an e-mail or
a phone that has not found a free surrogate after WIDEN attempts too, so layouts of few values do not run full.

Only DataFrame functions are used.  Distinct values are found by aggregation, so a value that a third of
all rows hold is one row; occurrences join their surrogates by value, and texts are put together by row.

Defined cases: a null text stays null; a text without entities stays as it is; repeated rows are
treated alike; a null key column is fine; an empty table gives an empty result; other columns pass
through unread; very long texts are searched whole, and repetitions in the patterns are bounded, so that no text
exhausts the stack of the search.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stored

#: Attempts before a layout is widened, and rounds without any progress after which an error is raised.
WIDEN, STALLED = 6, 40
#: Titles by gender, and first names by gender and script, which begin a name.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "M", "Señor", "Sr", "Sir", "Don"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña"]
OTHER_TITLES = ["Dr", "Prof", "Professor"]
MALE = ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Pierre", "Carlos", "José", "Juan", "Иван", "Алексей", "Сергей", "Дмитрий", "Γιώργος", "Νίκος"]
FEMALE = ["Mary", "Anna", "Maria", "Linda", "Elizabeth", "Susan", "Sarah", "Julia", "Ingrid", "Marie", "Carmen", "Sofía", "Lucía", "Ольга", "Елена", "Наталья", "Мария", "Ελένη", "Μαρία"]
#: Syllables and endings of made-up names, by script.
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "ka", "ke", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "ra", "re", "ro", "sa", "so", "ta", "te", "va", "ve"],
    "cyrillic": ["ба", "ве", "го", "да", "жо", "за", "ки", "ла", "ме", "но", "па", "ре", "са", "ти", "фе", "ха"],
    "greek": ["βα", "γε", "δο", "ζα", "θε", "κα", "λε", "μα", "νο", "πα", "ρε", "σα", "τε", "φα", "χο", "ψα"],
}
ENDINGS = {"n": {"latin": "ry", "cyrillic": "ль", "greek": "ις"}, "m": {"latin": "n", "cyrillic": "н", "greek": "ς"}, "f": {"latin": "lia", "cyrillic": "ня", "greek": "ία"}, "s": {"latin": "rt", "cyrillic": "ров", "greek": "κης"}}

#: What secrets of known issuers begin with.
PREFIX = "^(?:sk|pk|ghp|AKIA)[-_]?"

_TITLE = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
_FIRST = "|".join(MALE + FEMALE)
_NAME_WORD = r"\p{Lu}[\p{Ll}'’]+(?:-\p{Lu}\p{Ll}+)?"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:sk|pk|ghp|AKIA)[-_]?[A-Za-z0-9]{16,64})(?![A-Za-z0-9])",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\d-]*\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "name": rf"(?<!\p{{L}})(?:(?:{_TITLE})\.? {_NAME_WORD}(?: {_NAME_WORD})?|(?:{_FIRST})(?: {_NAME_WORD}){{1,2}})(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind_of(value: Column) -> Column:
    """The type of a match, by the first pattern that is all of it."""
    return F.coalesce(*(F.when(value.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()))


def _words_of_names(value: Column) -> Column:
    """array<struct<type, value>> of a name's words: title (kept), first name by gender, last name."""
    w = F.split(value, " ")
    bare = F.rtrim(w[0], F.lit("."))
    titled = bare.isin(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
    given = F.when(titled, F.when(F.size(w) > 2, w[1])).otherwise(bare)
    gender = F.when(bare.isin(MALE_TITLES) | given.isin(MALE), F.lit("m")).when(bare.isin(FEMALE_TITLES) | given.isin(FEMALE), F.lit("f")).otherwise(F.lit("n"))

    def word(x, i):
        first = F.when(titled, (i == 1) & (F.size(w) > 2)).otherwise(i == 0)
        kind = F.when(titled & (i == 0), F.lit("title")).when(first, F.concat(F.lit("name_"), gender)).otherwise(F.lit("name_s"))
        return F.struct(kind.alias("type"), x.alias("value"))

    return F.transform(w, word)


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(value.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def _hmac(secret: str, message: Column) -> Column:
    """HMAC-SHA-256 as hex digits."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _digits(value: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(value, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def luhn(value: Column) -> Column:
    """The digit that a card number, whose last digit is yet to come, ends with."""
    d = F.reverse(_digits(value))
    double = F.transform(d, lambda x, i: F.when(i % 2 == 0, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x))
    return F.pmod(F.negative(F.aggregate(double, F.lit(0), lambda a, x: a + x)), F.lit(10)).cast("string")


def iban_check(value: Column) -> Column:
    """The two check digits of a bank number, whatever it has in their place."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 2), F.lit("00"))
    step = lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97))
    return F.lpad((98 - F.aggregate(F.split(turned, ""), F.lit(0), step)).cast("string"), 2, "0")


def surrogate(kind: Column, value: Column, attempt: Column, secret: str) -> Column:
    """The replacement for a value of a type."""
    seed = F.concat_ws("\x1f", kind, value, attempt.cast("string"))
    stream = F.concat(*(_hmac(secret, F.concat(F.lit(f"{i}\x1f"), seed)) for i in range(3)))  # 192 hex digits
    code = lambda i: F.conv(F.substring(stream, F.pmod(i * 2, F.lit(190)) + 1, F.lit(2)), 16, 10).cast("int")
    hexed = kind == "secret"

    def char(c, i):
        low = c.rlike("[a-z]")
        letters = F.when(hexed & value.rlike("^[0-9a-f]+$"), F.lit("abcdef")).when(hexed & value.rlike("^[0-9A-F]+$"), F.lit("ABCDEF")).when(low, F.lit("abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        return F.when(c.rlike("[0-9]"), F.pmod(code(i), F.lit(10)).cast("string")).when(c.rlike("[A-Za-z]"), F.substring(letters, F.pmod(code(i), F.length(letters)) + 1, F.lit(1))).otherwise(c)

    layout = lambda text: F.array_join(F.transform(F.split(text, ""), char), "")
    octets = F.concat_ws(".", *(F.pmod(code(F.lit(i)), F.lit(254)) + 1 for i in range(4)))
    # what is kept: country code and bank country, a card's first digit, the prefix of a secret, top domain
    head = F.when(kind == "phone", F.regexp_extract(value, r"^\+\d{1,3}(?=[ .-])", 0)).when(kind == "iban", F.substring(value, 1, 2)).when(kind == "card", F.substring(value, 1, 1))
    head = head.when(kind == "secret", F.regexp_extract(value, PREFIX, 0)).otherwise(F.lit(""))
    tail = F.when(kind == "email", F.regexp_extract(value, r"\.[A-Za-z]{2,}$", 0)).otherwise(F.lit(""))
    middle = F.substring(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(tail))
    script = _script(value)
    # a syllable more at each attempt, so that there are always free names
    parts = lambda s: F.array_join(F.transform(F.sequence(F.lit(0), attempt + 3), lambda k: F.element_at(F.array(*map(F.lit, SYLLABLES[s])), F.pmod(code(k), F.lit(len(SYLLABLES[s]))) + 1)), "")
    stem = F.when(script == "cyrillic", parts("cyrillic")).when(script == "greek", parts("greek")).otherwise(parts("latin"))
    end = reduce(lambda a, g: reduce(lambda b, s: b.when((kind == f"name_{g}") & (script == s), F.lit(ENDINGS[g][s])), SYLLABLES, a), ENDINGS, F.when(F.lit(False), F.lit("")))
    name = F.initcap(F.concat(stem, F.coalesce(end, F.lit(""))))
    wide, laid = F.greatest(attempt - WIDEN + 1, F.lit(0)), layout(middle)
    more = F.array_join(F.transform(F.sequence(F.lit(1), wide), lambda k: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(code(k + 40), F.lit(26)) + 1, F.lit(1))), "")
    # the local part grows up to the 64 characters that it may have
    email = F.when((wide > 0) & (F.length(F.substring_index(value, "@", 1)) + wide <= 64), F.concat(more, laid, tail)).otherwise(F.concat(laid, tail))
    phone = F.when((wide > 0) & value.startswith("+"), F.concat(head, laid, F.lit("-"), F.lpad(F.pmod(code(F.lit(60)), F.lit(100)).cast("string"), 2, "0"))).otherwise(F.concat(head, laid))
    iban = F.concat(F.substring(value, 1, 2), F.lit("00"), layout(F.substring(value, F.lit(5), F.length(value))))
    iban = F.concat(F.substring(value, 1, 2), iban_check(iban), F.substring(iban, F.lit(5), F.length(iban)))
    card = F.concat(head, laid)
    card = F.substring(card, F.lit(1), F.length(card) - 1)
    made = F.when(kind == "title", value).when(kind.startswith("name_"), name).when(kind == "ipv4", octets).when(kind == "email", email).when(kind == "phone", phone)
    return made.when(kind == "iban", iban).when(kind == "card", F.concat(card, luhn(card))).otherwise(F.concat(head, laid, tail))


def table(values: DataFrame, secret: str) -> DataFrame:
    """values: type, value (distinct).  type, value, surrogate; one to one within a type, and no surrogate a value of the type."""
    todo, done = stored(values.filter("type <> 'title'").withColumn("attempt", F.lit(0)), "values"), None
    left, stalled = None, 0
    while stalled < STALLED:
        drawn = todo.withColumn("surrogate", surrogate(F.col("type"), F.col("value"), F.col("attempt"), secret))
        pool = drawn.withColumn("old", F.lit(1))
        if done is not None:
            pool = pool.unionByName(done.withColumn("old", F.lit(0)))
        first = pool.groupBy("type", "surrogate").agg(F.min(F.struct("old", "value")).alias("first"))
        real = values.select("type", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        judged = pool.join(first, ["type", "surrogate"]).join(real, ["type", "surrogate"], "left")
        judged = judged.withColumn("ok", (F.col("first.value") == F.col("value")) & F.col("real").isNull())
        judged = stored(judged.select("type", "value", "attempt", "surrogate", "ok"), "drawn")
        done = judged.filter("ok").drop("ok")
        todo = judged.filter("not ok").select("type", "value", (F.col("attempt") + 1).alias("attempt"))
        was, left = left, todo.count()
        if not left:
            return done.select("type", "value", "surrogate")
        stalled = 0 if was is None or left < was else stalled + 1
    raise ValueError(f"{left} values have found no free surrogate in {STALLED} rounds: more values than surrogates of their layout")


def _named(piece: Column, names: Column) -> Column:
    """array<struct<text, hit>>: the words of a text and what is between them, with the row's own names replaced."""
    tokens = F.split(piece, r"(?<![\p{L}'’-])(?=[\p{L}'’-])|(?<=[\p{L}'’-])(?![\p{L}'’-])")
    # a word that is no name as it stands may hold one between marks, as in a possessive
    inner = lambda x: F.when(F.element_at(names, x).isNull() & x.rlike("['’-]"), F.split(x, r"(?=['’]s?$)|(?<!\p{L})(?=\p{L})|(?<=\p{L})(?!\p{L})")).otherwise(F.array(x))
    whole = F.flatten(F.transform(tokens, inner))
    return F.transform(whole, lambda x: F.struct(F.coalesce(F.element_at(names, x), x).alias("text"), F.element_at(names, x).isNotNull().alias("hit")))


def replaced(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """__row, __id, __text (with surrogates), __n (entities replaced)."""
    if not secret:
        raise ValueError("a secret is needed: without one anybody can draw the same surrogates")
    rows = packed(docs, __id=key, __text=text)
    found = F.when(F.col("__text").rlike(ANY), F.regexp_extract_all("__text", F.lit(ANY), F.lit(0)))
    rid = F.concat_ws("/", F.col("__id").cast("string"), F.md5(F.coalesce(F.col("__text"), F.lit("")).cast("binary")))
    hits = rows.select(rid.alias("rid"), found.alias("found")).filter("found is not null")
    spots = hits.select("rid", F.posexplode("found").alias("at", "match")).withColumn("type", kind_of(F.col("match")))
    parts = F.when(F.col("type") == "name", _words_of_names(F.col("match"))).otherwise(F.array(F.struct("type", F.col("match").alias("value"))))
    spots = spots.select("rid", "at", F.posexplode(parts).alias("part", "v")).select("rid", "at", "part", "v.type", "v.value")
    spots = stored(spots, "entities")
    mapping = stored(table(spots.select("type", "value").distinct(), secret), "surrogates")
    new = spots.join(mapping, ["type", "value"], "left").withColumn("surrogate", F.coalesce("surrogate", "value"))
    # match by match first, so that the i-th of a row's texts is that of its i-th match (repeated rows count once)
    name = F.when(F.col("type").startswith("name_"), F.struct("value", "type", "surrogate"))
    by_match = new.groupBy("rid", "at").agg(F.array_sort(F.collect_set(F.struct("part", "surrogate"))).alias("parts"), F.collect_set(name).alias("names"))
    by_match = by_match.withColumn("text", F.array_join(F.transform("parts", lambda x: x["surrogate"]), " "))
    per_row = by_match.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("spots"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    # a last name's surrogate where a word is both: the last entry of a word is taken
    only = F.filter("names", lambda x, i: ~F.coalesce(F.get(F.col("names"), i + 1)["value"] == x["value"], F.lit(False)))
    names = F.map_from_entries(F.transform(only, lambda x: F.struct(x["value"], x["surrogate"])))
    per_row = per_row.withColumn("names", F.when(F.size("names") > 0, names))
    whole = rows.withColumn("rid", rid).join(per_row, "rid", "left")
    n = F.size("spots")
    # the text between matches, then match and text in turn
    between = F.split("__text", ANY)
    at = lambda i: F.get(F.col("spots"), i)["text"]
    named = F.transform(between, lambda x: F.when(F.col("names").isNull(), x).otherwise(F.array_join(F.transform(_named(x, F.col("names")), lambda w: w["text"]), "")))
    more = F.when(F.col("names").isNotNull(), F.size(F.filter(F.flatten(F.transform(between, lambda x: _named(x, F.col("names")))), lambda w: w["hit"])))
    turn = F.transform(named, lambda x, i: F.when(i == 0, x).otherwise(F.concat(at(i - 1), x)))
    out = F.when(F.col("spots").isNull(), F.col("__text")).otherwise(F.array_join(turn, ""))
    return whole.select("__row", "__id", out.alias("__text"), (F.when(F.col("spots").isNull(), 0).otherwise(n) + F.coalesce(more, F.lit(0))).alias("__n"))


def pseudonymize(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with surrogates in its texts."""
    done = replaced(docs, secret, key, text)
    return done.select(*(F.col("__text").alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
