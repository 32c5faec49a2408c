"""Files of pages and images into texts: which pages are read, what of them counts, joined in order.

Pages and images are rows, so a file of hundreds of pages is never one array before its text is made:
files of more than `most` pages are left out; text of a page with a broken encoding is dropped; of equal images of a file the first
by page and place is described; a file whose pages all lack text is read by OCR, its first `fallback`
pages; a page is its own text, then what its images say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions import adapters

PAGES, FALLBACK = 400, 15


def page_texts(pages: DataFrame, images: DataFrame, describer: adapters.Model, ocr: adapters.Model, key: str = "storage_path", most: int = PAGES, fallback: int = FALLBACK) -> DataFrame:
    """(key, page, text) of pages (key, page, text, content) and images (key, page, pos, content), pages without any text left out.

    describer and ocr say what an image and a page show; each is asked once for every one that counts.
    """
    read = adapters.pages_to_read(pages, key, most, fallback)
    own = read.select(key, "page", F.when(F.col("ocr_fallback"), ocr(F.when(F.col("ocr_fallback"), F.col("content")))).otherwise(F.col("text")).alias("text"))
    first = adapters.unique_images(images, key, "page", "pos").join(read.select(key, "page"), [key, "page"], "left_semi")
    described = first.select(key, "page", "pos", describer(F.col("content")).alias("said")).where(F.trim(F.coalesce("said", F.lit(""))) != "")
    said = described.groupBy(key, "page").agg(F.sort_array(F.collect_list(F.struct("pos", "said"))).alias("said"))
    joined = own.join(said, [key, "page"], "left").select(key, "page", adapters.page_text(F.col("text"), F.col("said.said")).alias("text"))
    return joined.where(F.trim("text") != "")


def file_text(texts: DataFrame, key: str = "storage_path", joiner: str = "\n\n") -> DataFrame:
    """(key, text): the pages of a file in their order."""
    return texts.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("page", "text"))).text, joiner).alias("text"))

