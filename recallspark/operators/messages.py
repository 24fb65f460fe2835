"""Mailbox between clients: quotas on the way in, a bounded page on the way out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recallspark.functions.rank import top_k
from recallspark.schema import INBOX_LIMIT, MAX_MESSAGE_CHARS, MAX_UNREAD_PER_SENDER


def unread(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("read_at").isNull()).groupBy("to_client").agg(F.count("*").alias("unread"))


def waiting(messages: DataFrame) -> DataFrame:
    """Unread messages per sender and recipient, and whether the quota is used up."""
    counts = messages.where(F.col("read_at").isNull()).groupBy("from_client", "to_client").agg(
        F.count("*").alias("waiting"))
    return counts.withColumn("full", F.col("waiting") >= MAX_UNREAD_PER_SENDER)


def inbox(messages: DataFrame, unread_only: bool = True, limit: int = INBOX_LIMIT) -> DataFrame:
    """Newest ``limit`` messages of every client. Bodies are quoted data, never instructions."""
    kept = messages.where(F.col("read_at").isNull()) if unread_only else messages
    page = top_k(kept, ["to_client"], [F.col("sent_at").desc(), F.col("id")], limit, spread_on="id")
    return page.select("to_client", "rn", "id", "from_client", "sent_at", F.col("read_at").isNotNull().alias("read"),
                       F.col("body").alias("untrusted_body"))


def mark_read(messages: DataFrame, shown: DataFrame, now: str) -> DataFrame:
    hit = shown.select("id", F.lit(True).alias("_shown")).distinct()
    return messages.join(hit, "id", "left").withColumn(
        "read_at", F.coalesce("read_at", F.when(F.col("_shown"), F.lit(now)))).drop("_shown")


def send(outgoing: DataFrame, messages: DataFrame, clients: DataFrame) -> DataFrame:
    """Add ``outcome`` to each outgoing message: ``sent`` or why it was refused.

    ``outgoing``: ``id, from_client, to_name, body, sent_at``. A sender's quota is
    spent in arrival order; only as many rows as the quota are ranked per pair.
    """
    named = clients.select(F.col("name").alias("to_name"), F.col("client_id").alias("to_client"), "revoked_at")
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"^\s+|\s+$", "")
    rows = outgoing.withColumn("body", body).join(named, "to_name", "left")
    first = (
        F.when(F.col("body") == "", "empty")
        .when(F.length("body") > MAX_MESSAGE_CHARS, "too long")
        .when(F.col("to_client").isNull(), "unknown recipient")
        .when(F.col("revoked_at").isNotNull(), "recipient revoked")
        .when(F.col("to_client") == F.col("from_client"), "own client")
    )
    rows = rows.withColumn("_refused", first)
    pair = ["from_client", "to_client"]
    admitted = top_k(
        rows.where(F.col("_refused").isNull()).select("id", *pair, "sent_at"), pair,
        [F.col("sent_at"), F.col("id")], MAX_UNREAD_PER_SENDER, spread_on="id"
    ).join(waiting(messages).select(*pair, "waiting"), pair, "left").where(
        F.col("rn") + F.coalesce("waiting", F.lit(0)) <= MAX_UNREAD_PER_SENDER)
    return (
        rows.join(admitted.select("id", F.lit(True).alias("_in")), "id", "left")
        .withColumn("outcome", F.coalesce("_refused", F.when(F.col("_in"), "sent").otherwise("too many unread")))
        .drop("_refused", "_in", "revoked_at")
    )
