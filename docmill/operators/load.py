"""Files into a vector table, end to end: read, cut, embed, pack, replace by path, and say how it went."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import adapters, office
from docmill.functions import text as X
from docmill.operators import chunking, ingest
from docmill.sources import buckets
from docmill.sources.tables import bounded_batches, passing, spent, written


OFFICE = ("docx", "xlsx", "pptx")


def paged(files: DataFrame, describer: adapters.Model | None = None) -> DataFrame:
    """files (storage_path, content, processor) with pages (number, name, text), status and message.

    Office files have a page for each sheet or slide; other formats one; what has no reader is skipped with a message that says so.
    Every file is opened by its own reader, once.
    """
    single = {k: f for k, f in adapters.EXTRACTORS.items() if k not in OFFICE}
    office_file = F.coalesce(F.col("processor").isin(*OFFICE), F.lit(False))
    read = files.withColumn("__pages", office.pages_by(F.when(office_file, F.col("content")), F.col("processor")))
    read = adapters.extracted(read, single, describer).withColumn("text", F.when(office_file, F.array_join("__pages.text", "\n\n")).otherwise(F.col("text")))
    taken = office_file | (F.col("status") != "skipped")
    whole = F.array(F.struct(F.lit(1).alias("page"), F.lit(None).cast("string").alias("name"), F.col("text")))
    said = adapters.judged(read.withColumn("__kept", F.col("message")), taken).withColumn("message", F.when(F.col("status") == "skipped", F.col("__kept")).otherwise(F.col("message")))
    return said.withColumn("pages", F.when(office_file, F.col("__pages")).otherwise(whole)).drop("__pages", "__kept")


def embedded(chunks: DataFrame, embedder: Callable[[Column], Column] = adapters.embed, texts: str = "texts") -> DataFrame:
    """chunks with the vectors of an array of texts; a hosted embedder gets them in Arrow batches."""
    bounded_batches(chunks.sparkSession)
    return chunks.withColumn("embeddings", embedder(F.col(texts)))


def ingested(
    files: DataFrame, stored: DataFrame, library: str = "public", mode: str = "semantic", overwrite: bool = True, embedder: Callable[[Column], Column] = adapters.embed, describer: adapters.Model | None = None, **cut
) -> tuple[DataFrame, DataFrame]:
    """The vector table after loading files (storage_path, content, processor), and an outcome for each file.

    Without overwrite files that the table has are skipped; with it their old rows go.  Vectors carry the batch of
    EMBED_ROWS that embeds them and the request that stores them (payloads packed by size); a file's chunks alone are
    ordered, never the table's.  Cut files and vectors are tables in the shared folder: a file is read once and a chunk
    embedded once, whatever is made of them.
    """
    told = written(cut_up(files, stored, mode, overwrite, describer, **cut), "cut")
    vectors = written(vectors_of(told, library, embedder), "vectors")
    return ingest.replaced(stored, vectors.select(*stored.columns), "storage_path"), outcomes_of(told)


def stored_into(files: DataFrame, path: str, library: str = "public", mode: str = "semantic", overwrite: bool = True, embedder: Callable[[Column], Column] = adapters.embed, describer: adapters.Model | None = None, **cut) -> DataFrame:
    """Loads files into the bucketed vector table at path (see sources.buckets): their rows replace those of their paths, other buckets aren't written; returns the outcomes.

    Files are dealt to their buckets as they are cut, before there are vectors; these are made as the table is
    written.  The cut files go at the end, so that a load takes the disk of their texts and of the new rows.
    """
    spark = files.sparkSession
    own, of = buckets.of_key(spark, path)
    by_path = own == "storage_path"
    told = cut_up(files, buckets.read(spark, path), mode, overwrite, describer, **cut)
    with passing(buckets.dealt(told.withColumn("bucket", of)) if by_path else told, "cut", "bucket" if by_path else None) as told:
        vectors = vectors_of(told, library, embedder)
        if by_path:
            buckets.replace(vectors, told.where("n > 0").select("bucket", "storage_path").distinct(), path)
        else:
            buckets.upsert(vectors, path)
        with spent(spark):
            return written(outcomes_of(told), "outcomes")


def cut_up(files: DataFrame, stored: DataFrame, mode: str = "semantic", overwrite: bool = True, describer: adapters.Model | None = None, **cut) -> DataFrame:
    """files as (storage_path, known, status, message, n, items): a row a file with its n chunks, items (page, ordinal, chunk); a file without a path has none."""
    asked = files.withColumn("known", F.lit(False))
    if not overwrite:
        have = stored.select("storage_path").distinct().withColumn("__known", F.lit(True))
        asked = files.join(have, "storage_path", "left").withColumn("known", F.col("__known").isNotNull()).drop("__known")
    # What is skipped isn't opened.
    content = F.when(~F.col("known"), F.col("content"))
    told = paged(asked.withColumn("content", content), describer).select("storage_path", "known", "pages", "status", "message")
    fit = F.coalesce((F.col("status") == "success") & ~F.col("known") & F.col("storage_path").isNotNull(), F.lit(False))
    told = chunking.once(told.withColumn("pages", F.coalesce(F.when(fit, F.col("pages")), F.slice("pages", 1, 0))), "pages")
    told = chunking.chunk_lists(told.withColumn("__texts", F.transform("pages", lambda p: p["text"])), "__texts", mode, **cut)
    item = lambda page: lambda chunk, i: F.struct(page.alias("page"), i.cast("int").alias("ordinal"), chunk.alias("chunk"))
    items = F.flatten(F.zip_with("pages", "chunks", lambda p, chunks: F.transform(chunks, item(p["page"]))))
    return chunking.once(told.withColumn("items", items), "items").select("storage_path", "known", "status", "message", F.size("items").alias("n"), "items")


def _a_row_a_path(told: DataFrame) -> DataFrame:
    """The files that have chunks; those of a path that several files give are numbered together."""
    full = told.where("n > 0").drop("known", "status", "message", "n")
    with spent(told.sparkSession):
        again = full.groupBy("storage_path").count().where("count > 1").select("storage_path")
        if again.isEmpty():
            return full
    keys = [c for c in full.columns if c != "items"]
    one = full.join(again, "storage_path", "left_semi").select(*keys, F.explode("items").alias("i"))
    of_page = Window.partitionBy("storage_path", "i.page").orderBy("i.ordinal", "i.chunk")
    item = F.struct(F.col("i.page").alias("page"), (F.row_number().over(of_page) - 1).alias("ordinal"), F.col("i.chunk").alias("chunk"))
    together = one.select(*keys, item.alias("item")).groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items"))
    return full.join(again, "storage_path", "left_anti").unionByName(together)


def vectors_of(told: DataFrame, library: str = "public", embedder: Callable[[Column], Column] = adapters.embed) -> DataFrame:
    """The rows of the vector table that cut files make; a file's numbers are made in its row, so that nothing is shuffled.  A bucket that told has stays."""
    rows = _a_row_a_path(told).withColumn("texts", F.transform("items", lambda x: x["chunk"]))
    rows = chunking.once(embedded(rows, embedder).withColumn("__name", X.ascii_safe(X.base_name(F.col("storage_path")))), "embeddings", "__name")
    path, name = F.col("storage_path"), F.col("__name")
    # As a payload to store, in the order of its JSON.
    payload = lambda x, v: F.struct(X.chunk_id(path, x["page"], x["ordinal"], name=name).alias("chunk_id"), v.alias("values"), x["chunk"].alias("chunk_text"), path.alias("storage_path"), x["page"].alias("page"))
    rows = chunking.once(rows.withColumn("__payloads", F.zip_with("items", "embeddings", payload)), "__payloads")
    requests = chunking.packed(F.transform("__payloads", lambda x: F.octet_length(F.to_json(x)).cast("long")))
    stored = F.zip_with("items", F.zip_with("__payloads", requests, lambda x, n: F.struct(x.alias("x"), n.alias("request"))), lambda i, p: F.struct(i["ordinal"].alias("ordinal"), p["x"].alias("x"), p["request"].alias("request")))
    kept = [c for c in told.columns if c == "bucket"]
    return rows.select("storage_path", *kept, F.posexplode(stored).alias("__at", "i")).select(
        "storage_path", "i.x.page", "i.ordinal", "i.x.chunk_id", "i.x.chunk_text", F.col("i.x.values").alias("embedding"), F.floor(F.col("__at") / chunking.EMBED_ROWS).cast("int").alias("batch"), "i.request",
        X.base_name(F.col("storage_path")).alias("doc_name"), F.lit(library).alias("library"), X.first_segment(F.col("storage_path")).alias("source"), *kept,
    )


def outcomes_of(told: DataFrame) -> DataFrame:
    """What became of each cut file."""
    counts = told.where("n > 0").groupBy("storage_path").agg(F.sum("n").cast("int").alias("n"))
    result = told.drop("n", "items").join(counts, "storage_path", "left")
    message = F.when((F.col("status") == "success") & ~F.col("known") & F.col("n").isNull(), "No chunks generated").otherwise(F.col("message"))
    status = F.when(message == "No chunks generated", "error").otherwise(F.col("status"))
    n = F.coalesce(F.col("n"), F.lit(0))
    batches = F.ceil(n / F.lit(chunking.EMBED_ROWS)).cast("int")
    return result.select("storage_path", ingest.outcome(status, message, F.col("known"), F.lit(False)).alias("outcome"), message.alias("message"), n.alias("chunks"), n.alias("upserted"), batches.alias("batches"))
