"""Mixing sources to target weights by repetition rates.

Sizes (words) are summed per source; a source's target is its weighted share of a budget,
stopped at `most` times its size, the excess shared again by weight among the others.  Its rate
is target / size; a document appears floor(rate) times and once more with the fraction's
probability, decided by a hash of seed and id, so reruns and retried tasks agree and no document
waits for another.  Sizes and targets, one row per source, are written to the shared folder; they
are broadcast where they are BROADCAST_SOURCES rows or fewer, and joined by a shuffle beyond.

Defined cases: a null or empty text has size 0 and takes nothing; null is a source of its own,
ranked last; texts of any length count whole; rows that repeat an id share its draw; sources that
reach their caps at one level do so in the order of their names; a source of size 0 has target and rate 0;
an empty table gives an empty result.  Working columns carry a prefix no input should have, so
extra columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.shared import written

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST = 2
#: Rows of some hundred bytes at most that are sent to every task.
BROADCAST_SOURCES = 100_000
SEED = "mix-1"
P = "__mix_"


def size_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text: places where such a character follows none."""
    joined = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(joined) - F.length(F.translate(joined, "x", "")), F.lit(0)).cast("long")


def draw(row_id: Column, seed: str = SEED) -> Column:
    """A number of [0, 1) with 52 bits from md5(seed:id)."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(row_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """One row per source: its size and target.

    With caps at `most` times the size, the targets are min(cap, level * weight).  Sources in
    order of cap / weight reach their caps one after another; the level that the rest then have
    is right at the first source it doesn't fill.  These windows run in one task over one row per
    source, which Spark spills if they are many.
    """
    totals = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    ranked = totals.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_first())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    steps = ranked.select(
        "*",
        (F.sum("source_size").over(every) * share_percent - 100 * F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left100"),
        F.sum("weight").over(after).alias("open_weight"),
        F.row_number().over(order).alias("k"),
    )
    #: A source stays below its cap if its share of what earlier caps leave is less than its cap.
    below = F.col("left100") * F.col("weight") < 100 * F.col("cap") * F.col("open_weight")
    first = F.min(F.when(below, F.struct("k", "left100", "open_weight"))).over(every)
    capped = first.isNull() | (F.col("k") < first["k"])
    target = F.when(capped, F.col("cap").cast("double")).otherwise((first["left100"] * F.col("weight")).cast("double") / (100 * first["open_weight"]).cast("double"))
    return steps.select("source", "source_size", "weight", target.alias("target"))


def mixed(df: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **plan) -> DataFrame:
    """df with P + size, source_size, target, rate and copies (times the mix takes the row)."""
    sized = df.withColumn(P + "size", size_of(F.col(f"`{text}`")))
    targets = source_targets(sized.select(F.col(f"`{source}`").alias(P + "source"), P + "size"), P + "source", P + "size", **plan)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select(F.col("source").alias(P + "key"), *[F.col(c).alias(P + c) for c in ("source_size", "target")], rate.alias(P + "rate"))
    targets, _ = written(targets, "targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    out = sized.join(targets, F.col(f"`{source}`").eqNullSafe(F.col(P + "key")), "left").drop(P + "key")
    whole = F.floor(P + "rate")
    extra = (draw(F.col(f"`{row_id}`"), seed) < F.col(P + "rate") - whole).cast("int")
    return out.withColumn(P + "copies", (whole + extra).cast("int"))


def emitted(df: DataFrame, **kw) -> DataFrame:
    """The mix itself: df's rows, each as often as it is taken."""
    columns = df.columns
    copies = F.expr(f"sequence(1, {P}copies)")
    out = mixed(df, **kw).where(F.col(P + "copies") > 0)
    return out.select(*[F.col(f"`{c}`") for c in columns], F.explode(copies).alias(P + "copy")).drop(P + "copy")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs).select(
        "doc_id", F.col(P + "size").alias("size"), F.col(P + "source_size").alias("source_size"), F.col(P + "target").alias("target"),
        (F.col(P + "size") * F.col(P + "copies")).cast("long").alias("taken"), "source", F.col(P + "rate").alias("rate"), F.col(P + "copies").alias("copies"),
    )


#: From a table `sized` (source, size) to `targets` (source, source_size, target).
TARGETS_SQL = """
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, 2 * source_size AS cap, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight FROM totals),
steps AS (
  SELECT *, (sum(source_size) OVER () * 150 - 100 * coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left100,
    (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_weight, row_number() OVER o AS k
  FROM ranked WINDOW o AS (ORDER BY cap / weight, source NULLS FIRST)),
opened AS (SELECT k, left100, open_weight FROM steps WHERE left100 * weight < 100 * cap * open_weight ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN o.k IS NULL OR s.k < o.k THEN cap::DOUBLE ELSE (o.left100 * weight)::DOUBLE / (100 * o.open_weight)::DOUBLE END AS target
  FROM steps s LEFT JOIN opened o ON TRUE)
"""

DRAW_SQL = "('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"

SQL = (
    r"""WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),"""
    + TARGETS_SQL
    + f""",
rated AS (
  SELECT doc_id, size, t.source_size, target, s.source, CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0.0::DOUBLE END AS rate, {DRAW_SQL} AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies FROM rated)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, source, rate, copies FROM counted"""
)
