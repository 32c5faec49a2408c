"""Nearest vectors through an inverted file: cells around centres, codes of residuals, exact scores of a few.

`build` fits centres on a bounded sample, puts every vector into the cell of its centre and writes two
tables partitioned by cell: `codes` (a byte a dimension of what the vector differs from its centre) and
`vectors` (whole).  `search` probes the cells whose centres are nearest to a query: only their
partitions are read, codes rank their rows, and the best `wide` of each query fetch their whole vectors for
the exact score.  How many cells are probed is measured when the file is built: the fewest that
reach the wanted recall on queries held out of the sample; data without clusters needs many.
`retrieval.batch_top_k` is the exact way.

Sizes: the sample is SAMPLE rows at most, centres CELLS at most, queries come in blocks of
BLOCK rows.  A cell of any size is spread over files, and scored in tiles of SCORES numbers: a task holds
BLOCK * wide * k rows of four numbers, a few times over, however many rows a cell has.

Defined cases: null, empty, zero and wrongly long vectors are in no cell and never found; an empty table gives an
empty index; equal scores (to 9 decimals) go by id; repeated rows are found as often as they stand there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.operators.retrieval import DECIMALS

SAMPLE, CELLS, ROUNDS = 20_000, 1024, 15
#: Queries held out of the sample to choose the number of probes.
HELD = 200
BLOCK = 2048
#: Rows of a query that are scored exactly, times k.
WIDE = 20
#: Scores that a task holds at once (8 MB), and steps of a unit query's numbers beside codes.
SCORES, QUERY_STEPS = 1 << 20, 1 << 15


@dataclass(frozen=True)
class Index:
    """Where an inverted file stands, its unit centres, rows by cell, and cells to probe."""

    path: str
    centres: np.ndarray
    rows: np.ndarray
    probes: int

    @staticmethod
    def at(spark: SparkSession, path: str) -> Index:
        cells = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # CELLS rows at most
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        return Index(path, np.array([r["centre"] for r in cells], np.float32).reshape(len(cells), facts["size"]), np.array([r["n"] for r in cells], np.int64), facts["probes"])

    def share(self, queries: np.ndarray, probes: int | None = None) -> float:
        """The part of all rows that lies in the cells a query probes, on average."""
        near = nearest_cells(queries, self.centres, probes or self.probes)
        return float(self.rows[near].sum(axis=1).mean() / max(1, self.rows.sum()))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), np.float32(1e-30))


def nearest_cells(v: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(-(unit(v) @ centres.T), axis=1, kind="stable")[:, :probes]


def fitted(v: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centres of unit vectors by spherical k-means."""
    centres = v[np.sort(np.random.default_rng(seed).choice(len(v), min(cells, len(v)), replace=False))].copy()
    for _ in range(rounds):
        cell = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, v)
        full = np.bincount(cell, minlength=len(centres)) > 0
        centres[full] = unit(sums[full])
    return centres


def probes_needed(v: np.ndarray, held: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest nearest cells that hold `recall` of the k nearest of v, on average over held."""
    cell, k = (v @ centres.T).argmax(axis=1), min(k, len(v))
    best = np.argpartition(-(held @ v.T), k - 1, axis=1)[:, :k]
    order = nearest_cells(held, centres, len(centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(held), 0), axis=1)
    needed = np.take_along_axis(place, cell[best], axis=1)
    reached = np.array([(needed < p).mean() for p in range(1, len(centres) + 1)])
    return int(np.argmax(reached >= recall)) + 1


def build(vectors: DataFrame, path: str, row_id: str = "vec_id", values: str = "embedding", cells: int | None = None, k: int = 10, recall: float = 0.97, sample: int = SAMPLE) -> Index:
    """An inverted file of vectors at path; cells: by default 4 times the root of the rows, CELLS at most."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(f"`{row_id}`").cast("long").alias("id"), F.col(f"`{values}`").cast("array<float>").alias("v")).where("v IS NOT NULL AND size(v) > 0 AND exists(v, x -> x <> 0)")
    sizes = given.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").head(1)
    if not sizes:
        return _facts(spark, path, np.zeros((0, 0), np.float32), None, 1)
    size, n = sizes[0]["size"], sizes[0]["n"]
    given = given.where(F.size("v") == size)
    # The rows with the smallest hashes: about `sample` of them by a threshold, not by a sort of all.
    part = given.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30))).limit(2 * sample)
    v = unit(np.array([r["v"] for r in part.select("v").collect()], np.float32).reshape(-1, size))
    if not len(v):
        v = unit(np.array([r["v"] for r in given.select("v").head(1)], np.float32))
    held = v[: min(HELD, max(1, len(v) // 10))]
    centres = fitted(v, min(cells or int(4 * n**0.5), CELLS, max(1, len(v) // 4)))
    probes = probes_needed(v, held, centres, min(k + 1, len(v)), recall)
    placed = given.mapInArrow(_placed(centres), "cell int, id long, v array<float>, scale float, code binary")
    # By ranges of (cell, id): a large cell is several parts, small ones share one.
    dealt = placed.withColumn("h", F.xxhash64("id", "v")).repartitionByRange("cell", "h").drop("h")
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/all")
    stored = spark.read.schema("id long, v array<float>, scale float, code binary, cell int").parquet(f"{path}/all")
    counts = {r["cell"]: r["count"] for r in stored.groupBy("cell").count().collect()}
    return _facts(spark, path, centres, counts, probes)


def _placed(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            if not len(column):
                continue
            raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)
            v = unit(raw)
            cell = (v @ centres.T).argmax(axis=1)
            rest = v - centres[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-12).astype(np.float32)
            code = np.rint(rest / scale[:, None] * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), column, pa.array(scale), pa.array([c.tobytes() for c in code], pa.binary())], names=["cell", "id", "v", "scale", "code"])

    return run


def _facts(spark: SparkSession, path: str, centres: np.ndarray, counts: dict[int, int] | None, probes: int) -> Index:
    rows = [(i, [float(x) for x in c], (counts or {}).get(i, 0)) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<float>, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    spark.createDataFrame([(json.dumps({"size": int(centres.shape[1]), "probes": probes}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")
    return Index(path, centres, np.array([r[2] for r in rows], np.int64), probes)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, row_id: str = "vec_id", values: str = "embedding", probes: int | None = None, wide: int = WIDE) -> DataFrame:
    """(query_id, rank, id, score): for every row of queries the best k rows by cosine that its cells hold."""
    index = Index.at(spark, path)
    size = index.centres.shape[1] if len(index.centres) else 0
    asked = queries.select(F.col(f"`{row_id}`").cast("long").alias("query_id"), F.col(f"`{values}`").cast("array<float>").alias("q")).where(F.size("q") == size)
    out = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    n = max(1, -(-asked.count() // BLOCK)) if size else 0
    for b in range(n):
        rows = (asked if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b)).collect()  # about BLOCK rows
        if rows:
            out = out.unionByName(_block(spark, index, rows, k, probes or index.probes, wide))
    return out


class Few:
    """The best `most` of the rows seen so far for each of n queries, by score and then by id; holds four times as many at most, and those of one tile."""

    def __init__(self, n: int, most: int) -> None:
        self.most, self.room = most, 4 * n * most
        self.parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        self.held = 0
        #: What a query's next row must reach.
        self.bar = np.full(n, -np.inf)

    def add(self, asking: np.ndarray, score: np.ndarray, ids: np.ndarray, cell: int) -> None:
        """score: of each asking query (row) and each new row (column), whose ids are given."""
        bar = self.bar[asking]
        if score.shape[1] > self.most:
            bar = np.maximum(bar, np.partition(score, -self.most, axis=1)[:, -self.most])
            self.bar[asking] = bar
        row, column = np.nonzero(score >= bar[:, None])
        self.parts.append((asking[row].astype(np.int32), score[row, column], ids[column], np.full(len(row), cell, np.int32)))
        self.held += len(row)
        if self.held > self.room:
            self.rows()

    def rows(self) -> tuple[np.ndarray, ...]:
        """(query, score, id, cell); the others are forgotten."""
        at, near, ids, cell = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -near, at))
        place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        last = order[place == self.most - 1]
        self.bar[at[last]] = near[last]
        order = order[place < self.most]
        self.parts, self.held = [(at[order], near[order], ids[order], cell[order])], len(order)
        return self.parts[0]


def ranked_codes(batches: Iterator[pa.RecordBatch], q: np.ndarray, near: np.ndarray, centres: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """(at, near, id, cell): of the rows (cell, id, scale, code) the best `most` for each query by what their codes tell.

    Products are of whole numbers and thus exact in any order: equal rows have equal scores, and go by id.
    """
    best, whole = Few(len(q), most), np.rint(q * np.float64(QUERY_STEPS))
    for batch in batches:
        cells = batch.column(0).to_numpy()
        for cell in np.unique(cells):
            asking = np.flatnonzero((near == cell).any(axis=1))
            if not len(asking):
                continue
            base = (q[asking] * centres[cell].astype(np.float64)).sum(axis=1)
            rows, step = np.flatnonzero(cells == cell), max(1, SCORES // len(asking))
            for at in (rows[a : a + step] for a in range(0, len(rows), step)):
                code = np.frombuffer(b"".join(batch.column(3).take(pa.array(at)).to_pylist()), np.int8).reshape(len(at), -1)
                score = whole[asking] @ code.T.astype(np.float64)
                score *= batch.column(2).to_numpy()[at] / (127 * QUERY_STEPS)
                score += base[:, None]
                best.add(asking, score, batch.column(1).to_numpy()[at], int(cell))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], names=["at", "near", "id", "cell"])


def _block(spark: SparkSession, index: Index, rows: list, k: int, probes: int, wide: int) -> DataFrame:
    ids, q = np.array([r["query_id"] for r in rows], np.int64), unit(np.array([r["q"] for r in rows], np.float32))
    near = nearest_cells(q, index.centres, probes).astype(np.int32)
    sent = spark.sparkContext.broadcast((q, near, index.centres))
    wanted, most = [int(c) for c in np.unique(near)], wide * k
    stored = spark.read.schema("id long, v array<float>, scale float, code binary, cell int").parquet(f"{index.path}/all").where(F.col("cell").isin(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from ranked_codes(batches, *sent.value, most)

    codes = stored.select("cell", "id", "scale", "code").mapInArrow(run, T.StructType([T.StructField("at", T.IntegerType()), T.StructField("near", T.DoubleType()), T.StructField("id", T.LongType()), T.StructField("cell", T.IntegerType())]))
    place = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("near"), "id"))
    few = codes.withColumn("place", place).where(F.col("place") <= most).select("at", "id", "cell").distinct()
    # At most BLOCK * wide * k rows, of three numbers each.
    exact = stored.select("cell", "id", "v").join(F.broadcast(few), ["cell", "id"])
    kind = "query_id long, id long, score double"

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value[0].astype(np.float64)
        for batch in batches:
            if len(batch):
                v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
                at = batch.column(0).to_numpy()
                s = np.einsum("ij,ij->i", q[at] / np.linalg.norm(q[at], axis=1, keepdims=True), v) / np.linalg.norm(v, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), batch.column(1), pa.array(s)], names=["query_id", "id", "score"])

    scored = exact.select("at", "id", "v").mapInArrow(scores, kind)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DECIMALS)), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
