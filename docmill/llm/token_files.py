"""Token ids as Parquet files: one list a document, in the order of ids, read by column and by row group.

`written` deals texts by range of id, so that shard k holds smaller ids than shard k + 1, sorts each
shard, encodes it in a stream and writes one file a shard: `tokens` has doc_id, shard, at (ids of
the shard before this document), n_tokens and ids, `shards` one row a shard with its first and last
id, its sums and `base`, the ids of all shards before it.  A document's place in the whole run of ids
is base + at, so nothing is ever summed over all documents in one place.  Ids are dictionary-coded
(16 bits an id for 50,000 of them) or delta-coded; row groups and pages are small enough to be
read alone, and every file has the page index, so a filter on doc_id reads the pages it needs and a
read of lengths or places touches no ids.

Texts are moved once, before they are encoded: their shuffle is smaller than one of ids, and the
sampling for ranges never encodes.  The number of shards follows the size of the texts (SHARD_BYTES),
up to MAX_SHARDS, from where shards grow.

Defined cases: a null text is an empty one and holds the end id alone; a null id comes first; rows of one id
are ordered by hash of text, equal rows in any order, as their ids are equal; they may fill many shards;
texts of any length are encoded whole; an empty table gives an empty result; extra columns are left out of the files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm import ids as I
from docmill.llm.shared import bounded_batches, folder

SHARD_BYTES, MAX_SHARDS = 32 << 20, 1 << 18
#: Bytes of a row group and of a page, and rows of a page at most.
GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 8 << 20, 256 << 10, 512
#: Bytes of texts encoded at a time.
TEXT_BYTES = 2 << 20
IDS = "ids.list.element"


def options(encoding: str = "dictionary", group_bytes: int = GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> dict[str, str]:
    """Options of Spark's Parquet writer."""
    coded = {"dictionary": {"parquet.enable.dictionary": "true"}, "delta": {"parquet.enable.dictionary": "true", f"parquet.enable.dictionary#{IDS}": "false"}}[encoding]
    return coded | {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows), "compression": "zstd"}


def _parts(column: pa.Array, most: int = TEXT_BYTES) -> Iterator[pa.Array]:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield column.slice(at, to - at)
        at = to


def encoded(df: DataFrame, tokenizer: str, end: int | None) -> DataFrame:
    """doc_id, shard (of the partition), at, n_tokens, ids of df's doc_id and text, in the order of its partitions' rows."""
    schema = T.StructType([df.schema["doc_id"], T.StructField("shard", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = I.worker((tokenizer, "default"), lambda: I.Cache(I.TokenizersFile(tokenizer)))
        shard, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc, row = batch.column(batch.schema.get_field_index("doc_id")), 0
            for part in _parts(batch.column(batch.schema.get_field_index("text"))):
                flat, bounds = cache.ids(part, end)
                n = len(part)
                columns = [doc.slice(row, n), pa.array(np.full(n, shard, np.int32)), pa.array(before + bounds[:-1]), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                row, before = row + n, before + int(bounds[-1])

    return df.mapInArrow(run, schema)


def written(df: DataFrame, path: str, tokenizer: str, row_id: str = "doc_id", text: str = "text", end: int | None = None, shard_bytes: int = SHARD_BYTES, **how) -> None:
    """Files of the ids of df's texts below path; `end` is put behind each text.  how: see options()."""
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(f"`{row_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MAX_SHARDS, max(1, -(-size // shard_bytes)))
    # Rows of one id, and equal rows, are told apart for the ranges, so that none has to hold them all.
    docs = docs.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = docs.repartitionByRange(shards, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    encoded(dealt.select("doc_id", "text"), tokenizer, end).write.options(**options(**how)).mode("overwrite").parquet(f"{path}/tokens")
    spark = df.sparkSession
    tokens = spark.read.parquet(f"{path}/tokens")
    sums = tokens.groupBy("shard").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
    # One row a shard, MAX_SHARDS at most.
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    sums.select("*", base).coalesce(1).write.mode("overwrite").parquet(f"{path}/shards")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; columns and rows that aren't asked for aren't read."""
    base = spark.read.parquet(f"{path}/shards").select("shard", "base")
    tokens = spark.read.parquet(f"{path}/tokens")
    return tokens.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """tokens with ids_crc32, the CRC-32 of its ids as little-endian unsigned 32-bit integers, in place of ids."""
    names = [c for c in tokens.columns if c not in ("ids", "ids_crc32")]
    schema = T.StructType([tokens.schema[c] for c in names] + [T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            flat, bounds = column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), column.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(flat)).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(sums, pa.int64())], names=schema.names)

    return tokens.mapInArrow(run, schema)


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = folder(spark, "token-files")
    written(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return checksums(read(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
