"""Readers and writers: files by folder, texts, JSON and CSV with their odd shapes, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as X
from docmill.functions import values as V

_own = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share; where it is unset, a local one if all runs on one machine."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        _own = found = _own or "file://" + tempfile.mkdtemp(prefix="docmill-")
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/docmill-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def spent(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go when it has ended, not when the driver's memory happens to be collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def passing(df: DataFrame, what: str, by: str | None = None) -> Iterator[DataFrame]:
    """df as a compressed table in the shared folder, partitioned by a column if wanted, that goes at the end of the block: nothing lazy may read it then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docmill-{what}-{uuid.uuid4().hex}"
    try:
        with spent(spark):
            compressed(df, by).parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        removed(spark, path)


def compressed(df: DataFrame, by: str | None = None) -> DataFrameWriter:
    """A writer by a codec that takes two thirds of the default one's disk on text."""
    out = df.write.option("compression", "zstd")
    return out.partitionBy(by) if by else out


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of an Arrow batch whose rows are made larger in Python.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session carry at most BATCH_BYTES (a single longer row apart), unless they are bounded tighter already; it stays so, as results are lazy."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below root with path, size, content, content type and the processor for it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    kind = V.content_type(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("path"))
    return raw.select(F.col("path").alias("storage_path"), F.col("length").alias("size"), "modificationTime", "content", kind.alias("content_type"), V.processor(kind, F.col("path")).alias("processor"))


def texts(spark: SparkSession, root: str) -> DataFrame:
    """Whole .txt files that aren't outputs, decoded as UTF-8 or else Latin-1."""
    raw = files(spark, root, "*.txt").where(~F.col("storage_path").endswith("_output.txt"))
    return raw.select("storage_path", V.decoded_text(F.col("content")).alias("text"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON file: a list, an object with `records`, or an object a line.

    The first character decides: text is read whole only where it is one JSON value.
    """
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    line = spark.read.text(path).select(F.trim("value").alias("value"))
    rows = lambda value, kind: F.from_json(value, kind)
    listed = whole.where(F.col("value").startswith("[")).select(F.explode(rows(F.col("value"), f"array<struct<{schema}>>")).alias("r"))
    held = whole.where(F.get_json_object("value", "$.records").isNotNull()).select(F.explode(rows(F.get_json_object("value", "$.records"), f"array<struct<{schema}>>")).alias("r"))
    single = line.where(F.col("value").startswith("{") & F.col("value").endswith("}") & F.get_json_object("value", "$.records").isNull()).select(rows(F.col("value"), f"struct<{schema}>").alias("r"))
    return listed.unionByName(held).unionByName(single).select("r.*")


def postal_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=";", header=True)


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, appended."""
    df.write.mode("append").json(path)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def write_enveloped(df: DataFrame, path: str, source: str, processed_at: str) -> None:
    """Records as JSON lines, and their number, time and source in a file beside them.  One file of both: sources.enveloped."""
    df.write.mode("overwrite").json(f"{path}/records")
    facts = df.agg(F.count("*").alias("total_records")).select("total_records", F.lit(processed_at).alias("processed_at"), F.lit(source).alias("source"))
    facts.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep=";", header=True)


def write_by_group(df: DataFrame, path: str, column: str) -> None:
    """A folder of CSV files for each value of a column, named by its clean form."""
    df.withColumn("export_name", X.name_export(F.col(column))).write.mode("overwrite").partitionBy("export_name").csv(path, sep=";", header=True)


def write_absent(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the table at path doesn't have; returns them."""
    try:
        have = df.sparkSession.read.parquet(path).select(key)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        have = df.sparkSession.createDataFrame([], df.select(key).schema)
    new = written(df.join(have, key, "left_anti"), "absent")
    new.write.mode("append").parquet(path)
    return new


def write_mark(spark: SparkSession, path: str, key: str) -> None:
    """The key of the last entry done, for resumed() of a later run; an older one is replaced."""
    spark.createDataFrame([(key,)], "value string").write.mode("overwrite").text(path)


def read_mark(spark: SparkSession, path: str) -> str | None:
    """The key written last; null where none was."""
    try:
        return next((r["value"] for r in spark.read.text(path).head(1)), None)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def failure_report(outcomes: DataFrame, path: str) -> int:
    """`file | step | error` lines of the failed files; an older report is replaced, or emptied if nothing failed."""
    failed = outcomes.where("outcome = 'failed'").select(F.concat_ws(" | ", "storage_path", "step", "message").alias("value"))
    failed.write.mode("overwrite").text(path)
    return failed.count()


def messages(spark: SparkSession, url: str, table_name: str, **options: str) -> DataFrame:
    """A relational table by JDBC; filters and columns are pushed to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table_name, **options).load()
