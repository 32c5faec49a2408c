"""Tables in the shared folder of the cluster, written to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from docmill.sources.tables import shared_dir


#: Bytes of an Arrow batch on its way to Python; both sides hold a few of them a task.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session carry at most BATCH_BYTES (a single longer row apart), unless they are bounded tighter already.

    Whole texts go through these batches, so the number of rows is no bound on memory.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs inside; they are put back behind it."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/docmill-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read again, and its path: lost executors cost no more than a new read of it."""
    spark = df.sparkSession
    path = folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
