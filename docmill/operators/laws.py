"""Laws from a listing: up to the first one stored, those a model finds relevant, their articles by the first way that works, as text files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import adapters, markup
from docmill.functions import text as X
from docmill.functions import values as V
from docmill.operators import chat, ingest

# What a page of a law says that isn't in force yet, and the mark of a link to its XML.
NOT_PUBLISHED, XML_LINK = "NON ANCORA ESISTENTE O VIGENTE", "caricaAKN"


def not_published(html: Column) -> Column:
    return F.contains(html, F.lit(NOT_PUBLISHED))


def xml_link(html: Column, page: Column) -> Column:
    """The address of the law's XML, of the first anchor that leads to it."""
    found = F.filter(markup.hrefs(html), lambda h: F.contains(h, F.lit(XML_LINK)))
    return X.absolute(F.get(found, F.lit(0)), page)


def articles(entries: DataFrame, fetched: DataFrame) -> DataFrame:
    """entries (url, ...) with their page's title and articles (num, text); fetched (url, body) is what was crawled.

    The law's XML is tried first, then the loaders its page calls, in the order of their first mention and each
    distinct segment once, then the article on the page itself.  Pages and parts are joined by address.
    """
    body = fetched.select(F.col("url").alias("__url"), "body")
    pages = entries.join(body, F.col("url") == F.col("__url")).drop("__url").where(~not_published(F.col("body"))).withColumnRenamed("body", "html")
    kind = "array<struct<num: string, text: string>>"
    links = pages.select("url", xml_link(F.col("html"), F.col("url")).alias("link"))
    by_xml = links.join(body, F.col("link") == F.col("__url")).select("url", markup.law_articles("body").cast(kind).alias("by_xml"))
    loaders = pages.select("url", F.posexplode(markup.loader_paths(F.col("html"))).alias("pos", "path")).groupBy("url", "path").agg(F.min("pos").alias("pos"))
    parts = loaders.select("url", "pos", X.absolute(F.col("path"), F.col("url")).alias("link")).join(body, F.col("link") == F.col("__url"))
    read = parts.select("url", "pos", markup.law_article("body").alias("a")).where("a.text IS NOT NULL").select("url", "pos", F.col("a.num").alias("num"), F.col("a.text").alias("text"))
    joined = chat.assembled(read, "url", "num", "pos", "text")
    by_loader = joined.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("first_pos", "num", F.col("body").alias("text")))).alias("a")).select("url", F.transform("a", lambda x: F.struct(x["num"].alias("num"), x["text"].alias("text"))).cast(kind).alias("by_loader"))
    own = markup.law_article("html")
    by_page = F.when(own["text"].isNotNull(), F.array(F.struct(own["num"].alias("num"), own["text"].alias("text")))).cast(kind)
    ways = pages.join(by_xml, "url", "left").join(by_loader, "url", "left")
    return ways.withColumn("law_title", markup.law_title("html")).withColumn("articles", adapters.law_text(F.col("by_xml"), F.col("by_loader"), by_page)).drop("by_xml", "by_loader", "html")


def document(url: Column, title: Column, subtitle: Column, law_title: Column, found: Column) -> Column:
    """A law's file: header, title, and its articles with a line between."""
    lines = F.transform(found, lambda a: F.concat(a["num"], F.lit("\n"), F.trim(a["text"]), F.lit("\n")))
    head = F.concat(F.lit("url: "), url, F.lit("\ntitle: "), title, F.lit("\nsubtitle: "), subtitle, F.lit("\n\n---\n"))
    return F.concat_ws("\n", head, F.when(law_title.isNotNull(), F.concat(law_title, F.lit("\n"))), F.array_join(lines, "\n"))


def relevant_laws(entries: DataFrame, stored: DataFrame, fetched: DataFrame, model: Callable[[Column], Column], lane: str = "lane", pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """entries (lane, pos, url, title, subtitle), newest first in their lane, as files (file, text), and one row of counts.

    A lane ends at the first entry whose address or file is stored (url, file); what the model doesn't answer as
    relevant is left out, and so is what has no articles.
    """
    named = entries.withColumn("file", X.decree_name(F.col("title")))
    by_url = stored.select("url").where("url IS NOT NULL")
    new = ingest.take_while_new(ingest.take_while_new(named, by_url, "url", lane, pos), stored.select("file").where("file IS NOT NULL"), "file", lane, pos)
    judged = new.withColumn("relevant", V.relevant(model(F.col("subtitle"))))
    read = articles(judged.where("relevant AND url IS NOT NULL"), fetched).where("articles IS NOT NULL AND file IS NOT NULL")
    files = read.select(lane, pos, "url", "file", document(F.col("url"), F.col("title"), F.col("subtitle"), F.col("law_title"), F.col("articles")).alias("text"))
    counts = entries.agg(F.count("*").alias("total_found")).crossJoin(judged.agg(F.count("*").alias("total_checked"), F.count_if("relevant").alias("relevant_count"))).crossJoin(files.agg(F.count("*").alias("files_saved")))  # one row each
    return files, counts
