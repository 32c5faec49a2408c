"""Hosted models and binary formats behind small protocols, with deterministic stand-ins.

An adapter is a function of Columns or DataFrames, so that a hosted service takes the stand-in's
place by an Arrow-batched function of the same shape and the plans around it stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import markup, office
from docmill.functions import values as V
from docmill.operators import retrieval


class Embedder(Protocol):
    """Vectors of a list of texts."""

    def __call__(self, texts: Column) -> Column: ...


class Reranker(Protocol):
    """The best n of the candidates for a query."""

    def __call__(self, candidates: DataFrame, query: str, n: int) -> DataFrame: ...


class Model(Protocol):
    """A model's answer to each prompt."""

    def __call__(self, prompt: Column) -> Column: ...


def embed(texts: Column) -> Column:
    return V.hashed_vectors(texts)


def rerank(candidates: DataFrame, query: str, n: int) -> DataFrame:
    return retrieval.lexical_rerank(candidates, query, n, F.col("pos"))


def echo(prompt: Column) -> Column:
    """A model that answers with a hash of its prompt: the same answer in every run."""
    return F.concat(F.lit("answer "), F.md5(prompt))


def chain(*steps: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Prompt, model and parser one behind the other."""

    def run(value: Column) -> Column:
        for step in steps:
            value = step(value)
        return value

    return run


def describable(kind: Column, content: Column) -> Column:
    """Images that a vision model takes: known formats of at most 20 MiB."""
    return F.lower(kind).isin(*[f"image/{e}" for e in V.IMAGE_EXTENSIONS]) & (F.octet_length(content) <= V.IMAGE_BYTES) & (F.octet_length(content) > 0)


#: Text of each format whose reader is at hand, by processor name; one page a file.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "text": V.decoded_text,
    "xml": lambda content: markup.xml_text(V.decoded_text(content), F.lit(50)),
    **{kind: (lambda content, kind=kind: office.text(content, kind)) for kind in ("docx", "xlsx", "pptx")},
}


def extracted(files: DataFrame, extractors: dict[str, Callable[[Column], Column]] = EXTRACTORS, describer: Model | None = None) -> DataFrame:
    """files (storage_path, content, processor) with text, status and message.

    A reader is handed the content of its own files and null for all others, so none is opened by another's reader.  A format
    without one is skipped with a message that says so; pass one to read it.  describer says what images show: of those that
    a vision model takes (`describable`); others are skipped.
    """
    processor, content = F.col("processor"), F.col("content")
    readers = dict(extractors)
    taken = F.coalesce(processor.isin(*readers), F.lit(False))
    unfit = F.lit(False)
    if describer:
        fits = F.coalesce(describable(V.content_type(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("storage_path")), content), F.lit(False))
        readers["image"] = lambda own: describer(F.when(fits, own))
        unfit = F.coalesce(processor == "image", F.lit(False)) & ~fits
        taken = taken | (F.coalesce(processor == "image", F.lit(False)) & fits)
    text = F.coalesce(*[F.when(processor == name, read(F.when(processor == name, content))) for name, read in readers.items()])
    return judged(files.withColumn("text", text), taken, unfit)


def judged(read: DataFrame, taken: Column, unfit: Column | None = None) -> DataFrame:
    """read (processor, text) with status and message; taken: has a reader; unfit: an image that no model takes."""
    blank = F.trim(F.coalesce(F.col("text"), F.lit(""))) == ""
    why = F.when(unfit if unfit is not None else F.lit(False), F.lit("image not supported: format or size")).otherwise(F.concat(F.lit("format not supported: "), "processor"))
    message = F.when(F.col("processor").isNull(), "No document processor available").when(~taken, why).when(blank, "No chunks generated").otherwise("")
    status = F.when(F.col("processor").isNull(), "error").when(~taken, "skipped").when(blank, "error").otherwise("success")
    return read.withColumn("status", status).withColumn("message", message)


def page_text(text: Column, image_texts: Column) -> Column:
    """A page's own text, if its encoding isn't broken, and what its images say."""
    own = F.when(~F.contains(F.lower(text), F.lit("(cid:")), F.nullif(F.trim(text), F.lit("")))
    return F.concat_ws("\n\n", own, F.array_join(image_texts, "\n\n"))


def pages_to_read(pages: DataFrame, key: str, most: int = 400, fallback: int = 15) -> DataFrame:
    """Pages of files within `most` pages; of files whose pages all lack text the first `fallback`, marked for OCR."""
    size = pages.groupBy(key).agg(F.count("*").alias("__pages"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("__texts"))
    read = pages.join(size, key).where(F.col("__pages") <= most)
    ocr = F.col("__texts") == 0
    return read.withColumn("ocr_fallback", ocr).where(~ocr | (F.col("page") <= fallback)).drop("__pages", "__texts")


def unique_images(images: DataFrame, key: str, *order: str) -> DataFrame:
    """The first of equal images of a file, over all its pages."""
    return images.groupBy(key, F.md5("content").alias("hash")).agg(F.min_by(F.struct(*[c for c in images.columns if c != key]), F.struct(*order)).alias("__i")).select(key, "hash", "__i.*")


def answered_files(files: DataFrame, stored: DataFrame, model: Model, key: str = "storage_path", text: str = "text") -> DataFrame:
    """files (key, text) that stored doesn't have, with the model's output and status; an empty text has an empty output, and no answer is an error."""
    new = files.join(stored.select(key).distinct(), key, "left_anti")
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    out = new.withColumn("output", F.when(blank, "").otherwise(model(F.col(text))))
    return out.withColumn("status", F.when(F.col("output").isNull(), "error").otherwise("success"))


def law_text(*ways: Column) -> Column:
    """The articles of the first way that found any."""
    return F.coalesce(*[F.when(F.size(w) > 0, w) for w in ways])
