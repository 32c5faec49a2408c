"""Statistics of a table that is loaded in parts: one row a load and group, merged and never counted anew.

A load adds its counts, sums, extremes and two sketches (distinct values, quantiles); what is asked of all loads merges
those rows, so that its cost follows the number of loads.  Counts, sums and extremes are exact; distinct values err by
some 1.6 % (LOG_K), ranks of quantiles by some 1.3 %.

Defined cases: null values count as rows and are in no sum, extreme or sketch; a group without any value has null
for them; a load that is added again under its name replaces itself; an empty load adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.sources import buckets

#: Registers of the sketch of distinct values, as a power of two.
LOG_K = 13


def summarized(df: DataFrame, load: str, group: str, value: str, distinct: str) -> DataFrame:
    """One row a group of df: its numbers and sketches under the name of the load."""
    number = F.col(value).cast("double")
    return df.groupBy(F.col(group).cast("string").alias("group")).agg(
        F.lit(load).alias("load"), F.count("*").alias("n"), F.count(number).alias("n_values"), F.sum(number).alias("total"), F.min(number).alias("least"), F.max(number).alias("most"),
        F.hll_sketch_agg(F.col(distinct).cast("string"), F.lit(LOG_K)).alias("distinct"), F.kll_sketch_agg_double(number).alias("ranks"),
    )


def add(summary: DataFrame, path: str) -> None:
    """The rows of a load into the table at path, in place of those it added before."""
    spark = summary.sparkSession
    try:
        buckets.read(spark, path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        buckets.create(summary.limit(0), path, key="load", buckets=64)
    buckets.upsert(summary, path)


def merged(spark: SparkSession, path: str, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """(group, n, total, mean, least, most, n_distinct, q50, ...) of all loads, from their rows."""
    rows = buckets.read(spark, path)
    agg = rows.groupBy("group").agg(
        F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"), F.kll_merge_agg_double("ranks").alias("ranks"),
    )
    q = [F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(x))).alias(f"q{round(100 * x)}") for x in quantiles]
    return agg.select("group", "n", "total", (F.col("total") / F.nullif(F.col("n_values"), F.lit(0))).alias("mean"), "least", "most", "n_distinct", *q)
