"""Tables of a relational database, read in parallel over ranges of a number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def partitioned(spark: SparkSession, url: str, table: str, column: str, partitions: int = 8, **options: str) -> DataFrame:
    """The table by JDBC in `partitions` ranges of `column`, whose bounds the database tells (one row); filters and columns are pushed to it.

    Rows with a null in the column are in the first range.  A table without rows, or with one value, is read as a whole.
    """
    own = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    bounds = spark.read.format("jdbc").options(url=url, query=f"SELECT MIN({own}) AS low, MAX({own}) AS high FROM {table}", **options).load().first()
    low, high = bounds[0], bounds[1]
    ranges = {} if low is None or low == high else {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(int(high) + 1), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **ranges, **options).load()
