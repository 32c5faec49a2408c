"""File streams that load what is new, and streams that drop what was seen."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery


def load_new(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """One pass over the files that the checkpoint hasn't seen: rows whose key target doesn't have are prepared and appended.

    The batch's anti-join makes a repeated batch harmless, so a restart loses and doubles nothing.
    """

    def batch(df: DataFrame, _: int) -> None:
        try:
            have = df.sparkSession.read.parquet(target).select(key)
            new = df.join(have, key, "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            new = df
        prepare(new.dropDuplicates([key])).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delivered(stream: DataFrame, send: Callable[[DataFrame], None], failed: str, checkpoint: str, attempts: int = 3) -> StreamingQuery:
    """Every micro-batch sent, again where sending fails; one that fails `attempts` times is written to `failed` with its error, and the next follows.

    A batch counts as done once it is sent or written there, so a restart repeats at most the batch at hand; send must bear repetition.
    """

    def batch(df: DataFrame, number: int) -> None:
        error: Exception | None = None
        for _ in range(attempts):
            try:
                return send(df)
            except Exception as e:
                error = e
        df.withColumn("batch", F.lit(number)).withColumn("error", F.lit(str(error)[:1000])).write.mode("append").parquet(failed)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, keys: list[str], time: str, within: str = "1 day") -> DataFrame:
    """Rows whose keys weren't seen within the time; state is dropped behind the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


class _Visited(StatefulProcessor):
    """A key's state is that it was seen; its first row goes on, all others are left out."""

    def __init__(self, order: str, forget_ms: int | None) -> None:
        self.order, self.forget_ms = order, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long", self.forget_ms)

    def handleInputRows(self, key, rows, timerValues):
        known, first = self.seen.exists(), None
        for part in rows:
            if not known:
                best = part.sort_values(self.order, kind="stable").iloc[:1]
                first = best if first is None or best[self.order].iloc[0] < first[self.order].iloc[0] else first
        if first is not None:
            self.seen.update((1,))
            yield first

    def close(self) -> None:
        pass


def visited(stream: DataFrame, keys: list[str], order: str, target: str, checkpoint: str, forget: timedelta | None = None) -> StreamingQuery:
    """Appends to target (Parquet) the first row by `order` of every key that no batch had before, and stops when all input at hand is read.

    What was visited is state without a horizon, kept over restarts by the checkpoint: Spark's own dropDuplicates, to which a batch
    hands one row a key.  Repeated rows of a key are dropped in their tasks first, so a key of many rows moves few.  With `forget`
    a key's state goes that long after it was seen, which dropDuplicates doesn't know: a processor in Python sees every key.
    """
    spark = stream.sparkSession

    def firsts(part: pa.Table) -> pa.Table:
        own = part.select([*keys, order]).to_pandas()
        return part.take(pa.array(sorted(own.sort_values(order, kind="stable").drop_duplicates(keys).index), pa.int64())).combine_chunks()

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from firsts(pa.Table.from_batches([batch])).to_batches()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each key of a partition one row; what is held is twice its distinct keys."""
        held: pa.Table | None = None
        done = 0
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held) > max(1 << 16, 2 * done):
                held = firsts(held)
                done = len(held)
        if held is not None:
            yield from firsts(held).to_batches()

    few = stream.mapInArrow(thinned, stream.schema)
    if forget is None:
        fresh = few.repartition(*keys).mapInArrow(first, stream.schema).dropDuplicates(keys)
    else:
        fresh = few.groupBy(*keys).transformWithStateInPandas(_Visited(order, int(forget.total_seconds() * 1000)), stream.schema, "Append", "ProcessingTime")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return fresh.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows by key in windows of the given width; later rows than `late` are left out."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
