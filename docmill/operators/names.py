"""Pairs of names of which one contains the other, case apart, by joins on the contained name's rarest run of letters.

If a name holds another, it holds all its runs of LETTERS letters, so it is enough to look where the
rarest of them occurs: the contained name asks with one run, the containing one is posted under
all of its own, and what meets is verified.  Names of up to LETTERS letters ask with themselves and meet the runs of
their length, so that what meets is a pair: numbers and other short names cost what they give.  Runs are posted
in the lengths alone that the other side asks with.  Both directions are the same join with sides exchanged.

Postings are many times their names, which Spark's size estimates don't see: these joins are sorted merges, never broadcasts.

Defined cases: an empty name is contained in every name; null names are in no
pair; equal names are a pair once; names that are repeated are joined once, by their distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = 8


def runs(name: Column, size: int) -> Column:
    """The distinct runs of `size` characters; none in shorter names."""
    n = F.length(name) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(name, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def contained(small: DataFrame, large: DataFrame) -> DataFrame:
    """(small, large): distinct names of one column `name` each, lower-cased, not empty, where large holds small."""
    name = F.col("name")
    asks = [r[0] for r in small.select(F.least(F.length(name), F.lit(LETTERS))).distinct().collect()]  # LETTERS numbers at most
    posted = lambda sizes: large.select(name.alias("large"), F.explode(F.concat(*[runs(name, k) for k in sizes])).alias("run"))
    whole = small.where(F.length(name) <= LETTERS).select(name.alias("small"), name.alias("run"))
    parts = small.where(F.length(name) > LETTERS).select(name.alias("small"), F.explode(runs(name, LETTERS)).alias("run"))
    often = posted([LETTERS]).groupBy("run").agg(F.count("*").alias("n"))
    # A run that the other side doesn't have at all settles it: nothing holds the name.
    rarest = parts.join(often.hint("merge"), "run", "left").groupBy("small").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"))
    return posted(sorted(asks) or [LETTERS]).join(whole.unionByName(rarest).hint("merge"), "run").where(F.contains("large", "small")).select("small", "large")


def containment(left: DataFrame, right: DataFrame, left_name: str = "name", right_name: str = "name") -> DataFrame:
    """(l, r): distinct lower-cased names of both sides where one contains the other or they are equal."""
    side = lambda df, c: df.select(F.lower(F.col(f"`{c}`")).alias("name")).where("name IS NOT NULL").distinct()
    a, b = side(left, left_name), side(right, right_name)
    some = "name <> ''"
    forth = contained(a.where(some), b.where(some)).select(F.col("small").alias("l"), F.col("large").alias("r"))
    back = contained(b.where(some), a.where(some)).select(F.col("large").alias("l"), F.col("small").alias("r"))
    out = forth.unionByName(back.where("l <> r"))
    # The empty name is in every name of the other side; whether a side has it is a fact of one bit.
    if not a.where("name = ''").isEmpty():
        out = out.unionByName(b.select(F.lit("").alias("l"), F.col("name").alias("r")))
    if not b.where("name = ''").isEmpty():  # two empty names are a pair of the line above
        out = out.unionByName(a.where(some).select(F.col("name").alias("l"), F.lit("").alias("r")))
    return out
