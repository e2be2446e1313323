"""Messages from any provider in one shape; what cannot be understood is kept aside and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def normalize_messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, skipped). A message needs an id, a mailbox and a readable date; attachments need a name."""
    read = raw.withColumn("received_at", F.col("received_on").cast("string").try_cast("timestamp"))
    good = F.col("id").isNotNull() & F.col("mailbox").isNotNull() & F.col("received_at").isNotNull()
    blank = F.lit("")
    names = F.transform(
        F.filter("attachments", lambda a: a["name"].isNotNull()),
        lambda a: F.struct(a["name"].alias("name"), F.coalesce(a["text"], blank).alias("text")),
    )
    messages = read.filter(good).select(
        "id", F.lower("mailbox").alias("mailbox"), *[F.coalesce(c, blank).alias(c) for c in ("folder", "from_addr", "to_addr", "subject", "preview")],
        "received_at", F.when(F.col("web_link").rlike("(?i)^https://"), F.col("web_link")).otherwise(blank).alias("web_link"),
        F.coalesce(names, F.array().cast("array<struct<name:string,text:string>>")).alias("attachments"),
    )
    return messages, read.filter(~good)
