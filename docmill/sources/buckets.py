"""Tables whose rows are replaced and deleted by path: hash buckets of the key as partitions, of which only touched ones are written.

A bucket is the unit of a rewrite: what is loaded or deleted tells its buckets (a bounded list, BUCKETS
at most), and Spark's dynamic partition overwrite puts new rows in the place of old ones when all tasks are
done; files of other buckets stay as they are.  Rows of buckets that keep other keys are read and written
aside first.  A key with very many rows makes a large bucket, which is written by several tasks.

Defined cases: a null key has a bucket of its own and is replaced by null keys; rows of the new load that repeat are
kept as they are; a load or delete that touches nothing writes nothing; an empty table is a table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.sources.tables import compressed, passing, removed, spent

BUCKETS = 4096
KEY = "storage_path"


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create(df: DataFrame, path: str, key: str = KEY, buckets: int = 64) -> None:
    """df as a new table at path; the number of buckets stays with it."""
    if not 0 < buckets <= BUCKETS:
        raise ValueError(f"1 to {BUCKETS} buckets, not {buckets}")
    spark = df.sparkSession
    spark.createDataFrame([(buckets, key, df.schema.json())], "buckets int, key string, kind string").coalesce(1).write.json(f"{path}/_facts")
    _put(dealt(df.withColumn("bucket", bucket(F.col(key), buckets))), path, "errorifexists")


def of_key(spark: SparkSession, path: str) -> tuple[str, Column]:
    """The key of the table and the bucket of a row that has it."""
    facts = _facts(spark, path)
    key = facts["key"]
    return key, bucket(F.col(key).cast(T.StructType.fromJson(json.loads(facts["kind"]))[key].dataType), facts["buckets"])


def dealt(df: DataFrame) -> DataFrame:
    """Rebalanced by bucket: small ones share a task, a large one is split over several."""
    return df.hint("rebalance", "bucket")


def _facts(spark: SparkSession, path: str):
    return spark.read.schema("buckets int, key string, kind string").json(f"{path}/_facts").first()


def _put(df: DataFrame, path: str, mode: str) -> None:
    with spent(df.sparkSession):
        compressed(df, "bucket").mode(mode).option("partitionOverwriteMode", "dynamic").parquet(f"{path}/rows")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    kind = T.StructType.fromJson(json.loads(_facts(spark, path)["kind"]))
    try:
        return spark.read.schema(kind.add("bucket", "integer")).parquet(f"{path}/rows")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], kind)  # nothing was ever written


def read(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path).drop("bucket")


def upsert(new: DataFrame, path: str) -> list[int]:
    """new in place of the rows that have its keys; returns the buckets written."""
    own, of = of_key(new.sparkSession, path)
    with passing(new.select(*read(new.sparkSession, path).columns, of.alias("bucket")), "upsert") as new:
        return replace(dealt(new), new.select("bucket", own).distinct(), path)


def replace(new: DataFrame, keys: DataFrame, path: str) -> list[int]:
    """upsert of rows that have their bucket already and read nothing of the table, given their distinct keys (with bucket); new is made once, as it is written.

    Old rows are read only in buckets that keep some.
    """
    spark = new.sparkSession
    own, _ = of_key(spark, path)
    old = _rows(spark, path)
    with spent(spark):
        touched = sorted(r[0] for r in keys.select("bucket").distinct().collect())
        if not touched:
            return []
        new = new.select(*[F.col(c).cast(old.schema[c].dataType) for c in old.columns if c != "bucket"], "bucket")
        old, keys = old.where(F.col("bucket").isin(touched)).alias("o"), keys.select("bucket", F.col(own).alias("__key")).alias("k")
        same = (F.col("o.bucket") == F.col("k.bucket")) & F.col(f"o.{own}").eqNullSafe(F.col("__key"))
        keeping = sorted(r[0] for r in old.select("bucket", own).distinct().alias("o").join(keys, same, "left_anti").select("bucket").distinct().collect())
    if not keeping:
        _put(new, path, "overwrite")
        return touched
    # Written aside first: a table isn't read while it is overwritten.
    with passing(old.where(F.col("o.bucket").isin(keeping)).join(keys, same, "left_anti").select("o.*"), "kept") as kept:
        _put(dealt(kept.unionByName(new)), path, "overwrite")
    return touched


def delete(spark: SparkSession, path: str, key: str | None = None, source: str | None = None, prefix: str | None = None) -> list[int]:
    """The table without the rows of one key, one source or one prefix of the key; returns the buckets written.  A key reads its bucket alone."""
    given = {k: v for k, v in (("key", key), ("source", source), ("prefix", prefix)) if v}
    if len(given) != 1:
        raise ValueError(f"exactly one of key, source and prefix, not {sorted(given) or 'none'}")
    facts, rows = _facts(spark, path), _rows(spark, path)
    own = F.col(facts["key"])
    gone = F.coalesce(own == key if key else F.col("source") == source if source else own.startswith(prefix), F.lit(False))
    if key:
        rows = rows.where(F.col("bucket") == bucket(F.lit(key), facts["buckets"]))
    touched = sorted(r[0] for r in rows.where(gone).select("bucket").distinct().collect())
    if touched:
        with passing(rows.where(F.col("bucket").isin(touched) & ~gone), "delete") as left:
            kept = {r[0] for r in left.select("bucket").distinct().collect()}
            if kept:
                _put(dealt(left), path, "overwrite")
        for b in set(touched) - kept:  # a partition without rows is not overwritten, it goes
            removed(spark, f"{path}/rows/bucket={b}")
    return touched
