"""Requests answered: attachments, history, the decision to retrieve, documents, prompt and model, for a table of requests at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import adapters
from docmill.functions import text as X
from docmill.functions import values as V
from docmill.operators import chat

#: What a prompt says ahead of its context; %s is the tone.
WITH_DOCUMENTS, WITHOUT = "Answer from the documents given. %s", "Answer from general knowledge. %s"
WRITE, REFINE = "Write a document by the template.", "Refine the document written before."


def _system(text: str, tone: Column) -> Column:
    return F.trim(F.concat(F.lit(text.partition("%s")[0]), F.coalesce(tone, F.lit(""))))


def answered(
    requests: DataFrame, messages: DataFrame, documents: DataFrame, judge: Callable[[Column], Column], model: Callable[[Column], Column] = adapters.echo,
    conversation: str = "conv_id", order: str = "turn",
) -> DataFrame:
    """requests (request_id, conv_id, message, attachments, image_texts, tone) with retrieve, n_documents, prompt and answer.

    The question is the message and what its images say.  Without a history documents are always asked for; with one the
    judge decides, and an answer that can't be read means yes.  documents (request_id, rank, name, text) are
    what retrieval found for each request, the best first; they count where retrieval is asked for.
    """
    past = chat.history(messages, conversation, order, ("user", "assistant"), "role")
    told = requests.join(past, conversation, "left")
    question = F.concat_ws("\n\n", "message", F.nullif(F.array_join("image_texts", "\n\n"), F.lit("")))
    asked = told.withColumn("question", question).withColumn("history", F.coalesce("history", F.lit("")))
    retrieve = F.when(F.col("history") == "", True).otherwise(F.coalesce(V.retrieve_asked(judge(F.concat_ws("\n", "history", "question"))), F.lit(True)))
    decided = asked.withColumn("retrieve", retrieve)
    shown = chat.context(documents, "request_id", "rank", "name", "text").join(documents.groupBy("request_id").agg(F.count("*").alias("__n")), "request_id")
    found = decided.join(shown, "request_id", "left")
    kept = found.withColumn("context", F.when(F.col("retrieve"), F.col("context"))).withColumn("n_documents", F.when(F.col("retrieve"), F.coalesce("__n", F.lit(0))).otherwise(0).cast("int"))
    system = F.when(F.col("retrieve"), _system(WITH_DOCUMENTS, F.col("tone"))).otherwise(_system(WITHOUT, F.col("tone")))
    prompt = F.concat_ws("\n\n", system, F.nullif(F.col("history"), F.lit("")), F.nullif(chat.full_context(F.col("attachments"), F.col("context")), F.lit("")), "question")
    return kept.withColumn("prompt", prompt).withColumn("answer", X.strip_citations(model(F.col("prompt")))).drop("__n", "n_messages")


def written(requests: DataFrame, messages: DataFrame, model: Callable[[Column], Column] = adapters.echo, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """requests (conv_id, message, template, requirements) with prompt and document: a refinement where the conversation has a history."""
    past = chat.history(messages, conversation, order, ("user", "assistant"), "role")
    told = requests.join(past, conversation, "left").withColumn("refined", F.coalesce(F.col("history"), F.lit("")) != "")
    prompt = F.concat_ws("\n\n", F.when(F.col("refined"), REFINE).otherwise(WRITE), F.nullif(F.coalesce("history", F.lit("")), F.lit("")), "template", "requirements", "message")
    return told.withColumn("prompt", prompt).withColumn("document", model(F.col("prompt"))).drop("n_messages")
