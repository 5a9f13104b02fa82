"""Money, purity, text and date columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Purity as a part of pure gold, and fineness marks.
FRACTION = {"24K": 24 / 24, "22K": 22 / 24, "18K": 18 / 24, "14K": 14 / 24}
FINENESS = {"999": "24K", "995": "24K", "916": "22K", "750": "18K", "583": "14K"}
GST = 0.03
GRAM, TEN_GRAMS = (8_000.0, 22_000.0), (80_000.0, 220_000.0)


def rounded(c: Column, places: int = 2) -> Column:
    """Half-up on the decimal value, once, at the output's edge."""
    return F.round(c.cast("decimal(24,6)"), places).cast("double")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value made once: within a lambda Spark makes an expression anew wherever it is read."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parse_amount(c: Column) -> Column:
    """Text with thousands commas to a finite double, else null."""
    return once(F.replace(c, F.lit(","), F.lit("")).try_cast("double"), lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))


def per_gram(v: Column, gram=GRAM, ten=TEN_GRAMS) -> Column:
    """A per-gram price as it is, a ten-gram price by ten, anything else null."""
    return once(v, lambda x: F.when(x.between(*gram), x).when(x.between(*ten), x / 10))


def _lookup(c: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def purity_fraction(purity: Column) -> Column:
    return _lookup(purity, FRACTION)


def fineness_to_karat(mark: Column) -> Column:
    return _lookup(mark, FINENESS)


def with_gst(price: Column, on=True) -> Column:
    on = on if isinstance(on, Column) else F.lit(on)
    return F.when(on, price * (1 + GST)).otherwise(price)


def safe_pct(move: Column, base: Column) -> Column:
    """move in percent of base; 0 where base is 0."""
    return F.coalesce(F.try_divide(move, base) * 100, F.lit(0.0))


def signed_pct(c: Column, places: int = 2) -> Column:
    return F.format_string(f"%+.{places}f%%", c)


def inr(v: Column, places: int = 0) -> Column:
    """Rupees with Indian grouping: the last three digits, then pairs."""
    text = F.format_string(f"%.{places}f", F.abs(F.round(v.cast("decimal(24,6)"), places)).cast("double"))
    whole, tail = F.regexp_extract(text, r"^\d+", 0), F.regexp_extract(text, r"\.\d+$", 0)
    front = F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))
    back = F.right(whole, F.lit(3))
    pairs = F.regexp_replace(front, r"(?<=\d)(?=(\d\d)+$)", ",")
    return F.concat(F.when(v < 0, "-").otherwise(""), F.lit("₹"), F.when(front == "", back).otherwise(F.concat(pairs, F.lit(","), back)), tail)


def norm_label(c: Column) -> Column:
    """The words of a label in lower case, joined by spaces; a capital after a small letter or digit begins a word."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Z%]*[a-z0-9%]+|[A-Z%]+"), F.lit(0))
    return F.lower(F.array_join(words, " "))


def visible_text(html: Column, drop_scripts: bool = True) -> Column:
    """Text of a page: scripts, styles and tags out, spaces collapsed."""
    s = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ") if drop_scripts else html
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?s)<[^>]+>", " "), r"\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def clean_domain(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^https?://", ""), r"^www\.|/.*$", "")


def clean_text(c: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def email_key(c: Column) -> Column:
    return F.lower(clean_text(c))


def first_name(c: Column) -> Column:
    return F.coalesce(F.element_at(F.split(clean_text(c), r"\s+"), 1), F.lit("there"))


def place_of_slug(c: Column) -> Column:
    """Title-cased place from 'gold-rate-<place>-d-mon-yyyy'."""
    return F.initcap(F.replace(F.regexp_extract(c, r"gold-rate-(.+?)-\d{1,2}-[a-z]{3}-\d{4}", 1), F.lit("-"), F.lit(" ")))


def post_office(c: Column) -> Column:
    """A post office's name without its kind."""
    return F.trim(F.regexp_replace(c, r"(?i)\s+(?:b\.?o|s\.?o|h\.?o|g\.?p\.?o)\.?$", ""))


def pin_ok(c: Column) -> Column:
    return c.rlike(r"^[1-9]\d{5}$")


def headline(title: Column, source: Column) -> Column:
    """Title without its ' - source' ending; null when it has 15 characters or fewer."""
    tail = F.concat(F.lit(" - "), source)
    t = F.trim(F.when(F.endswith(title, tail), F.substring(title, F.lit(1), F.length(title) - F.length(tail))).otherwise(title))
    return F.when(F.length(t) > 15, t)


def html_unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&#8377;", "₹"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unsubscribe_link(base: str, token: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/unsubscribe?token="), token)


def local_day(ts: Column) -> Column:
    """Calendar day in India (UTC + 5:30, no daylight saving)."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), ts.cast("timestamp_ntz")))


def date_slug(d: Column) -> Column:
    return F.lower(F.date_format(d, "d-MMM-yyyy"))


def date_display(d: Column) -> Column:
    return F.date_format(d, "dd MMMM yyyy")


def date_of_slug(c: Column) -> Column:
    """The date in a slug's last three parts, else null."""
    return F.to_date(F.try_to_timestamp(F.initcap(F.regexp_extract(c, r"(\d{1,2}-[a-z]{3}-\d{4})(?:\.html)?$", 1)), F.lit("d-MMM-yyyy")))


def pub_date(c: Column) -> Column:
    """RFC 822 date, else null.  The weekday's name is not read."""
    return F.try_to_timestamp(F.trim(F.substring(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), 1, 20)), F.lit("d MMM yyyy HH:mm:ss"))


def fresh(day: Column, as_of: Column, days: int) -> Column:
    return day >= F.date_sub(as_of, days)


def label_blank(c: Column, label: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(label))


def move_class(delta: Column, band: float = 0.5, inclusive: bool = False, names=("rose", "fell", "held")) -> Column:
    up, down = (delta >= band, delta <= -band) if inclusive else (delta > band, delta < -band)
    return F.when(up, names[0]).when(down, names[1]).otherwise(names[2])
