"""Subscriber tables: dedupe, merge policies, digest and unsubscribe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .sampling import newest_per_key

#: How a column of an incoming payload meets the stored one.
POLICIES = {
    "upsert": {"offers_optin": "incoming_true", "signup_method": "sticky_google"},
    "keep_optin": {"offers_optin": "stored", "country": "stored", "signup_method": "incoming"},
}


def dedupe_subscribers(subs: DataFrame, as_of: Column) -> DataFrame:
    """The newest row of each e-mail; rows without one stay."""
    return newest_per_key(subs, S.email_key(F.col("email")), [F.desc(F.coalesce("updated_at", as_of)), F.desc("id")])


def last_of_batch(payloads: DataFrame, columns: list[str], order: str = "seq") -> DataFrame:
    """Payloads of one key applied in order: the last non-blank value of each column.  Payloads without e-mail are rejected."""
    p = payloads.withColumn("key", S.email_key(F.col("email"))).filter("key is not null")
    aggs = []
    for c in columns:
        v = S.clean_text(F.col(c)) if p.schema[c].dataType.simpleString() == "string" else F.col(c)
        aggs.append(F.max_by(v, F.when(v.isNotNull(), F.col(order))).alias(c))
    return p.groupBy("key").agg(*aggs)


def merge_subscribers(target: DataFrame, payloads: DataFrame, columns: list[str], as_of: Column, mode: str = "upsert") -> DataFrame:
    """target: key, columns, updated_at.  Incoming non-null values win unless the policy of the column says otherwise."""
    policy, new = POLICIES[mode], last_of_batch(payloads, columns)
    t, n = target.withColumn("__t", F.lit(True)).alias("t"), new.withColumn("__n", F.lit(True)).alias("n")
    j = t.join(n, "key", "full")
    out = []
    for c in columns:
        old, inc = F.col(f"t.{c}"), F.col(f"n.{c}")
        how = policy.get(c, "incoming")
        if how == "incoming_true":
            v = F.when(F.col("__n"), F.coalesce(inc, F.lit(True))).otherwise(old)
        elif how == "sticky_google":
            v = F.when(old == "google", old).otherwise(F.coalesce(inc, old))
        elif how == "stored":
            v = F.when(F.col("__t"), old).otherwise(inc)
        else:
            v = F.coalesce(inc, old)
        out.append(v.alias(c))
    return j.select("key", *out, F.when(F.col("__n"), as_of).otherwise(F.col("t.updated_at")).alias("updated_at"))


def payload_rows(raw: DataFrame, columns: str, order: str = "seq") -> DataFrame:
    """raw: body (a JSON object), seq.  The fields named, of these types; a field that is missing or does not fit is null, and so are all of a
    body that is no object."""
    return raw.select(order, F.from_json("body", columns, {"mode": "PERMISSIVE"}).alias("r")).select(order, "r.*")


def upserted(target: DataFrame, raw: DataFrame, columns: str, as_of: Column, mode: str = "upsert") -> DataFrame:
    """merge_subscribers over JSON bodies; columns: fields and types, e-mail among them."""
    rows = payload_rows(raw, columns)
    return merge_subscribers(target, rows, [c for c in rows.columns if c not in ("seq", "email")], as_of, mode)


def tokens_of(merged: DataFrame, payloads: DataFrame) -> DataFrame:
    """What a payload gets back: id and token of its subscriber."""
    p = payloads.select("seq", S.email_key(F.col("email")).alias("key")).filter("key is not null")
    return p.join(merged.select("key", "id", "unsub_token"), "key").select("seq", "id", "unsub_token")


def fill_tokens(subs: DataFrame) -> DataFrame:
    return subs.withColumn("unsub_token", F.when(F.col("email").isNull(), F.col("unsub_token")).otherwise(F.coalesce("unsub_token", F.uuid())))


def reset_sends(subs: DataFrame) -> DataFrame:
    return subs.withColumn("last_emailed", F.lit(None).cast("date"))


def pending_digest(subs: DataFrame, as_of: Column) -> DataFrame:
    due = F.col("last_emailed").isNull() | (F.col("last_emailed") < as_of)
    return subs.filter(S.clean_text(F.col("email")).isNotNull() & F.col("unsub_token").isNotNull() & due)


def digest_rows(pending: DataFrame, snapshot: DataFrame, site: str) -> DataFrame:
    """snapshot: one row."""
    return pending.crossJoin(F.broadcast(snapshot.limit(1))).select(
        "id", "email", S.first_name(F.col("name")).alias("first_name"), S.unsubscribe_link(site, F.col("unsub_token")).alias("unsubscribe"), "rate_24k", "rate_22k", "lowest", "lowest_brand", "n"
    )


def mark_sent(subs: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """results: id, ok.  Only successes are marked, so failures stay pending."""
    sent = results.filter("ok").select("id").distinct().withColumn("__sent", F.lit(True))
    return subs.join(sent, "id", "left").withColumn("last_emailed", F.when(F.col("__sent"), as_of).otherwise(F.col("last_emailed"))).drop("__sent")


def accept_reasons(reasons: DataFrame, subs: DataFrame) -> DataFrame:
    """reasons: token, reason.  Those with a real token, cut to 200 characters, without identity."""
    real = reasons.join(subs.select(F.col("unsub_token").alias("token")), "token", "left_semi")
    return real.select(F.left(S.clean_text(F.col("reason")), F.lit(200)).alias("reason"))


def remove_unsubscribed(subs: DataFrame, tokens: DataFrame) -> DataFrame:
    """tokens: token."""
    return subs.join(tokens.select(F.col("token").alias("unsub_token")), "unsub_token", "left_anti")
