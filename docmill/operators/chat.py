"""Conversations and prompts: history, context, usage, articles put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How a prompt shows documents and its sections.
DOCUMENT_HEAD, DOCUMENT_TAIL = "<Documento n.", " estratto dalla Knowledge Base>"
SOURCE_LINE, CONTENT_LINE = "\n        |Fonte|: ", "\n        |Contenuto|: "
BETWEEN = "\n----------\n"
ATTACHMENTS_HEAD, KNOWLEDGE_HEAD = "<<<Allegati dell'utente>>>\n", "<<<Knowledge Base>>>\n"


def history(messages: DataFrame, conversation: str, order: str, keep: tuple[str, ...] = ("generated", "sent"), status: str = "status") -> DataFrame:
    """Per conversation its messages of the kept states as role: text lines in order."""
    items = messages.where(F.col(status).isin(*keep)) if status in messages.columns else messages
    lines = F.array_sort(F.collect_list(F.struct(order, "role", "text")))
    return items.groupBy(conversation).agg(F.array_join(F.transform(lines, lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("history"), F.count("*").alias("n_messages"))


def latest(messages: DataFrame, conversation: str, order: str, n: int = 5) -> DataFrame:
    """The last n messages of each conversation, the newest first."""
    rank = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(order)))
    return messages.withColumn("rank", rank).where(F.col("rank") <= n)


def context(documents: DataFrame, key: str, order: str, name: str, text: str) -> DataFrame:
    """Per key its documents, numbered in order, as one text."""
    items = F.array_sort(F.collect_list(F.struct(order, F.coalesce(name, F.lit("")).alias("name"), F.coalesce(text, F.lit("")).alias("text"))))
    block = lambda d, i: F.concat(F.lit(DOCUMENT_HEAD), (i + 1).cast("string"), F.lit(DOCUMENT_TAIL + SOURCE_LINE), d["name"], F.lit(CONTENT_LINE), d["text"])
    return documents.groupBy(key).agg(F.array_join(F.transform(items, block), BETWEEN).alias("context"))


def full_context(attachments: Column, documents: Column) -> Column:
    """Attachments above the knowledge base, each under its heading, empty ones left out."""
    some = lambda c, head: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    return F.concat_ws("\n\n", some(attachments, ATTACHMENTS_HEAD), some(documents, KNOWLEDGE_HEAD))


def usage(rows: DataFrame) -> DataFrame:
    """Means over the rows with usage, successes and errors, and the cost at given prices a thousand tokens."""
    have = F.col("tokens_in").isNotNull()
    fresh = F.greatest(F.col("tokens_in") - F.coalesce("cache_read", F.lit(0)), F.lit(0))
    return rows.agg(
        F.avg(F.when(have, F.col("tokens_in"))).alias("mean_in"), F.avg(F.when(have, F.col("tokens_out"))).alias("mean_out"), F.avg(F.when(have, fresh)).alias("mean_fresh"),
        F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") == "error").alias("n_error"),
    )


def cost(tokens_in: Column, tokens_out: Column, price_in: float = 0.000046, price_out: float = 0.000184) -> Column:
    return tokens_in / 1000 * F.lit(price_in) + tokens_out / 1000 * F.lit(price_out)


def assembled(segments: DataFrame, law: str, article: str, pos: str, text: str) -> DataFrame:
    """Articles in the order they first appear, each its distinct segments joined by blank lines."""
    items = segments.groupBy(law, article, text).agg(F.min(pos).alias(pos))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda s: s[text]), "\n\n")
    return items.groupBy(law, article).agg(F.min(pos).alias("first_pos"), parts.alias("body"))
