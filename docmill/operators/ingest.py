"""Incremental loading: what is new, how it went, and tables replaced in part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import markup


def not_stored(files: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """The files whose key the stored table doesn't have."""
    return files.join(stored.select(*keys).distinct(), [*keys], "left_anti")


def already_stored(files: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    return files.join(stored.select(*keys), [*keys], "left_semi")


def not_stored_by_header(listing: DataFrame, texts: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """Entries of a listing whose address no stored text has in its header."""
    have = texts.select(markup.header_value(F.col(text), "url").alias(url)).where(F.col(url) != "").distinct()
    return listing.join(have, url, "left_anti")


def source_hint(prefix: Column) -> Column:
    """The first part of a prefix that has several; null of one alone."""
    return F.when(F.contains(prefix, F.lit("/")), F.split_part(prefix, F.lit("/"), F.lit(1)))


def under_folder(path: Column, folder: str) -> Column:
    """In the folder itself or below: the folder's name ends at a slash."""
    return path.startswith(folder.rstrip("/") + "/")


def outcome(status: Column, message: Column, known: Column, failed: Column) -> Column:
    """What became of a file: skipped, deleted (a label only; nothing is removed here), processed or failed; the first rule that fits."""
    says = lambda *parts: F.coalesce(F.greatest(*[F.contains(message, F.lit(p)) for p in (*parts, parts[0])]), F.lit(False))
    return (
        F.when(known, "skipped")
        .when(failed & says("No /Root object"), "deleted")
        .when(failed, "failed")
        .when((status == "skipped") & says("unsupported", "not supported"), "deleted")
        .when(status == "skipped", "skipped")
        .when(status == "success", "processed")
        .when(says("No document processor available", "No chunks generated"), "deleted")
        .otherwise("failed")
    )


def summary(outcomes: DataFrame) -> DataFrame:
    """One row: files by outcome, chunks and vectors of the processed ones, and the exit code (1 if all failed)."""
    n = lambda name: F.count_if(F.col("outcome") == name)
    of_done = lambda c: F.coalesce(F.sum(F.when(F.col("outcome") == "processed", F.col(c))), F.lit(0)).cast("long")
    return outcomes.agg(
        F.count("*").alias("total_files"), n("processed").alias("processed"), n("failed").alias("failed"), n("skipped").alias("skipped"), n("deleted").alias("deleted"),
        of_done("chunks").alias("total_chunks"), of_done("upserted").alias("total_vectors"),
        F.when((F.count("*") > 0) & (n("failed") == F.count("*")), 1).otherwise(0).alias("exit_code"),
    )


def error_sample(outcomes: DataFrame, most: int = 10) -> DataFrame:
    """The first errors by path, and how many more there are."""
    failed = outcomes.where("outcome = 'failed'")
    more = failed.agg(F.greatest(F.count("*") - most, F.lit(0))).scalar()
    return failed.orderBy("storage_path").limit(most).withColumn("more", more)


def replaced(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*keys).distinct(), [*keys], "left_anti").unionByName(new)


def deleted(table: DataFrame, path: str | None = None, source: str | None = None, prefix: str | None = None) -> DataFrame:
    """table without the rows of one path, one source or one path prefix; exactly one of them is given."""
    given = {k: v for k, v in (("path", path), ("source", source), ("prefix", prefix)) if v}
    if len(given) != 1:
        raise ValueError(f"exactly one of path, source and prefix, not {sorted(given) or 'none'}")
    gone = F.col("storage_path") == path if path else F.col("source") == source if source else F.coalesce("storage_path", F.lit("")).startswith(prefix)
    return table.where(~F.coalesce(gone, F.lit(False)))


def normalized_path(path: Column, folder: str) -> Column:
    """Without a slash in front, in its folder."""
    bare = F.regexp_replace(path, "^/+|/+$", "")
    return F.when(F.lit(folder) == "", bare).when(bare.startswith(folder + "/"), bare).otherwise(F.concat(F.lit(folder + "/"), bare))


def take_while_new(listing: DataFrame, stored: DataFrame, key: str, lane: str, pos: str) -> DataFrame:
    """Of each lane the rows before the first that is stored already.

    The first stored place of a lane is an aggregate, so a lane of any length needs no window.
    """
    known = listing.join(stored.select(key).distinct(), key, "left_semi")
    first = known.groupBy(F.col(lane).alias("__lane")).agg(F.min(pos).alias("__first"))
    return listing.join(first, F.col(lane).eqNullSafe(F.col("__lane")), "left").where(F.col("__first").isNull() | (F.col(pos) < F.col("__first"))).drop("__lane", "__first")


def resumed(listing: DataFrame, key: str, at: str, pos: str) -> DataFrame:
    """Rows from the first with the key on; all of them if there is none."""
    first = listing.where(F.col(key) == at).agg(F.min(pos)).scalar()
    return listing.where(F.col(pos) >= F.coalesce(first, F.col(pos)))


def stop_after_idle(pages: DataFrame, lane: str, pos: str, new: str = "n_new", idle: int = 2) -> DataFrame:
    """Pages up to the first run of `idle` pages without anything new."""
    run = Window.partitionBy(lane).orderBy(pos)
    idle_here = (F.count_if(F.col(new) == 0).over(run.rowsBetween(1 - idle, 0)) == idle).cast("int")
    marked = pages.withColumn("__idle", idle_here)
    before = F.coalesce(F.sum("__idle").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("__before", before).where("__before = 0").drop("__idle", "__before")


def abort_after_repeats(segments: DataFrame, lane: str, pos: str, text: str, most: int = 10) -> DataFrame:
    """Distinct segments of a lane in order, until more than `most` repeated ones come in a row."""
    first = (F.row_number().over(Window.partitionBy(lane, text).orderBy(pos)) == 1).cast("int")
    run = Window.partitionBy(lane).orderBy(pos)
    islands = segments.withColumn("__new", first).withColumn("__island", F.sum("__new").over(run))
    in_row = F.sum(1 - F.col("__new")).over(Window.partitionBy(lane, "__island").orderBy(pos))
    stopped = islands.withColumn("__row", in_row).withColumn("__stop", F.max(F.when(F.col("__row") > most, 1).otherwise(0)).over(run))
    return stopped.where("__stop = 0 AND __new = 1").drop("__new", "__island", "__row", "__stop")


def rewritten(table: DataFrame, facts: DataFrame, key: str, value: str, column: str, order: str) -> DataFrame:
    """table with `column` replaced where facts know the key; of several facts the last by `order`."""
    last = facts.groupBy(key).agg(F.max_by(value, order).alias("__new"))
    return table.join(last, key, "left").withColumn(column, F.coalesce("__new", column)).withColumn("matched", F.col("__new").isNotNull()).drop("__new")


def stored_outcome(files: DataFrame, target: DataFrame, overwrite: bool) -> DataFrame:
    """Uploads against what is there: created; else exists (without overwrite), unchanged (same size) or replaced."""
    old = target.select("storage_path", F.col("size").alias("old_size"))
    kind = F.when(F.col("old_size").isNull(), "created").when(F.lit(not overwrite), "exists").when(F.col("old_size") == F.col("size"), "unchanged").otherwise("replaced")
    return files.join(old, "storage_path", "left").withColumn("outcome", kind)


def routed(library: Column, organization: Column, user: Column) -> tuple[Column, Column]:
    """Index and namespace of a library."""
    checked = F.when(library.isin("organization", "private", "public"), library).otherwise(F.raise_error(F.concat(F.lit("unknown library "), library)).cast("string"))
    return F.when(checked == "public", "public").otherwise(organization), F.when(checked == "organization", "organization").when(checked == "private", user)
