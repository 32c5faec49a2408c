"""Vector retrieval, BM25 ranking and the cascade of both, as DataFrame plans.

A request's vector is one row of literals; the vectors stay where they are and only each
partition's best rows travel.  Ties are broken by position, so results are total orders.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import text as X
from docmill.functions import values as V

LIBRARIES = ("organization", "private", "public")
#: Request defaults and the widths of the cascade.
CANDIDATES, THRESHOLD, LEXICAL, FINAL, DEFAULT_TOP = 100, 0.3, 25, 5, 5
K1, B, FLOOR = 1.5, 0.75, 0.25
#: Decimals of a score that count in a rank, and scores that a task holds at once (16 MB).
DECIMALS, SCORES = 9, 1 << 21


@dataclasses.dataclass(frozen=True)
class Request:
    """What to look for and where."""

    vector: Sequence[float]
    libraries: Sequence[str] = ("public",)
    top_k: int = DEFAULT_TOP
    threshold: float = THRESHOLD
    sources: Sequence[str] = ()
    user: str | None = None

    def __post_init__(self) -> None:
        unknown = sorted(set(self.libraries) - set(LIBRARIES))
        if unknown or not self.libraries:
            raise ValueError(f"unknown libraries {unknown}; known are {', '.join(LIBRARIES)}" if unknown else "no library")
        if "private" in self.libraries and not self.user:
            raise ValueError("the private library needs a user")


def clean_sources(sources: Sequence[str]) -> list[str]:
    """Trimmed, without blanks and repetitions, sorted; an empty list means no filter."""
    return sorted({s.strip() for s in sources if s and s.strip()})


def clean_sources_column(sources: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(sources, lambda s: F.trim(s)), lambda s: s != "")))


def source_filter(df: DataFrame, sources: Sequence[str], column: str = "source") -> DataFrame:
    """Rows of the sources; a row without a source is in none."""
    wanted = clean_sources(sources)
    return df.where(F.col(column).isin(*wanted)) if wanted else df


def scored(vectors: DataFrame, vector: Sequence[float], values: str = "embedding") -> DataFrame:
    query = F.array(*[F.lit(float(x)) for x in vector])
    return vectors.withColumn("score", V.cosine(F.col(values), query))


def top_k(hits: DataFrame, k: int, *tie: Column) -> DataFrame:
    return hits.orderBy(F.desc("score"), *tie).limit(k)


def by_library(vectors: DataFrame, request: Request, library: str = "library", row_id: str = "vec_id", k: int = CANDIDATES) -> DataFrame:
    """The best k of each asked library above the threshold, then the best k of all; equal scores keep the order of the libraries."""
    wanted = source_filter(vectors.where(F.col(library).isin(*request.libraries)), request.sources) if request.sources else vectors.where(F.col(library).isin(*request.libraries))
    hits = scored(wanted, request.vector).where(F.coalesce("score", F.lit(0.0)) >= request.threshold)
    order = F.element_at(V.literal_map({name: i for i, name in enumerate(LIBRARIES)}), F.col(library))
    ranked = hits.withColumn("hit", F.row_number().over(Window.partitionBy(library).orderBy(F.desc("score"), row_id))).where(F.col("hit") <= k)
    return top_k(ranked.withColumn("library_order", order), k, F.col("library_order"), F.col("hit"))


def hit_columns(hits: DataFrame) -> DataFrame:
    """Hits with all their fields: texts and names default to empty, the others to null."""
    have = set(hits.columns)
    take = lambda c, kind, default=None: (F.coalesce(F.col(c), F.lit(default)) if default is not None else F.col(c)).alias(c) if c in have else F.lit(default).cast(kind).alias(c)
    return hits.select(take("chunk_id", "string"), take("chunk_text", "string", ""), take("score", "double", 0.0), take("page", "int"), take("library", "string"), take("doc_name", "string", ""), take("storage_path", "string", ""), take("source", "string"))


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, row_id: str = "vec_id", values: str = "embedding", block: int = 4096) -> DataFrame:
    """(query_id, rank, row id, score): the best k rows by cosine for every row of queries.

    Queries come in blocks of bounded size; a task scores its rows against a block by matrix products of
    SCORES numbers at most and keeps k a query, so what travels is k rows a query and task.  Scores are
    ranked by 9 decimals and then by id: equal vectors have equal places, whatever the last bits of their products.
    """
    spark = vectors.sparkSession
    n = max(1, -(-queries.count() // block))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField(row_id, T.LongType()), T.StructField("score", T.DoubleType())])
    found = None
    for i in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64(row_id), F.lit(n)) == i)
        rows = part.select(F.col(row_id).cast("long"), F.col(values)).where(F.size(values) > 0).collect()
        if not rows:
            continue
        q = np.array([r[1] for r in rows], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), q))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best = Best(len(q), k)
            step = max(1, SCORES // len(q))
            for batch in batches:
                for part in (batch.slice(a, step) for a in range(0, len(batch), step)):
                    if (pc.list_value_length(part.column(1)).to_numpy() != q.shape[1]).any():
                        raise ValueError(f"vectors of other sizes than the queries' {q.shape[1]}")
                    v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                    size = np.linalg.norm(v, axis=1)
                    score = q @ (v / np.where(size > 0, size, 1)[:, None]).T
                    score[:, ~(size > 0)] = -np.inf
                    best.add(score, part.column(0).to_numpy())
            at, near, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(near), pa.array(score)], names=schema.names)

        hits = vectors.select(F.col(row_id).cast("long"), F.col(values)).where(F.size(values) > 0).mapInArrow(run, schema)
        found = hits if found is None else found.unionByName(hits)
    found = spark.createDataFrame([], schema) if found is None else found
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DECIMALS)), row_id))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


class Best:
    """The best k of the rows seen so far for each of n queries, by score to DECIMALS and then by id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.at, self.near, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: What a query's next row must reach, a rounding below its k-th best.
        self.bar = np.full(n, -np.inf)

    def add(self, score: np.ndarray, near: np.ndarray) -> None:
        """score: of each query (row) and each new row (column), whose ids are near."""
        score = np.where(np.isfinite(score), score, -np.inf)
        bar, slack = self.bar, 2 * 10.0**-DECIMALS
        if np.isneginf(bar).any() and score.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(score, -self.k, axis=1)[:, -self.k] - slack)
        at, column = np.nonzero((score >= bar[:, None]) & (score > -np.inf))
        if not len(at):
            return
        at, near, score = np.concatenate([self.at, at]), np.concatenate([self.near, near[column]]), np.concatenate([self.score, score[at, column]])
        order = np.lexsort((near, -np.round(score, DECIMALS), at))
        at, near, score = at[order], near[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        full = place == self.k - 1
        self.bar[at[full]] = score[full] - slack
        kept = place < self.k
        self.at, self.near, self.score = at[kept], near[kept], score[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score)"""
        return self.at, self.near, self.score


def first_of_text(df: DataFrame, text: str, order: str) -> DataFrame:
    """Of rows with one text the first by `order`; rows without text go."""
    some = df.where(F.coalesce(F.col(text), F.lit("")) != "")
    return some.groupBy(F.col(text).alias("__text")).agg(F.min_by(F.struct(*df.columns), order).alias("__first")).select("__first.*")


def bm25(candidates: DataFrame, query: str, text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """candidates with their Okapi BM25 score for the query's tokens, each as often as it is asked.

    Document frequencies and the mean length are one row of aggregates over the candidates; the floor of
    negative weights, a quarter of the mean raw weight of all terms, is counted only if a term needs it.
    Candidates without a hit score 0.
    """
    asked = _tokens(query)
    tokenized = candidates.withColumn("__t", X.tokens(F.coalesce(F.col(text), F.lit(""))))
    if not asked:
        return tokenized.withColumn("score", F.lit(0.0)).drop("__t")
    terms = sorted(set(asked))
    counts = [F.count_if(F.array_contains("__t", t)).alias(f"df{i}") for i, t in enumerate(terms)]
    facts = tokenized.agg(F.count("*").alias("n"), F.avg(F.size("__t")).alias("avgdl"), *counts).first()  # one row, whatever the candidates
    raw = [math.log(facts["n"] - facts[f"df{i}"] + 0.5) - math.log(facts[f"df{i}"] + 0.5) for i in range(len(terms))]
    if min(raw) < 0:
        frequency = tokenized.select(F.explode(F.array_distinct("__t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        mean = frequency.agg(F.avg(F.log(facts["n"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]
        raw = [w if w >= 0 else FLOOR * mean for w in raw]
    average = facts["avgdl"] or 1.0
    score = F.lit(0.0)
    for t, weight in zip(terms, raw, strict=True):
        tf = F.size(F.filter("__t", _same(t))).cast("double")
        norm = F.lit(1 - b) + F.lit(b / average) * F.size("__t")
        score = score + F.lit(weight * asked.count(t) * (k1 + 1)) * tf / (tf + k1 * norm)
    return tokenized.withColumn("score", score).select(*candidates.columns, "score")


def _same(term: str):
    return lambda x: x == term


def _tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bm25_top(candidates: DataFrame, query: str, k: int, *tie: Column, text: str = "text") -> DataFrame:
    """The best k candidates; without a token in the query, the first k."""
    ranked = bm25(candidates, query, text)
    return top_k(ranked, k, *tie) if _tokens(query) else ranked.orderBy(*tie).limit(k)


def lexical_rerank(candidates: DataFrame, query: str, k: int, *tie: Column, text: str = "text") -> DataFrame:
    """A stand-in for a hosted reranker: the share of the query's tokens that a candidate has."""
    asked = sorted(set(_tokens(query)))
    have = F.size(F.array_intersect(X.tokens(F.col(text)), F.array(*[F.lit(t) for t in asked]).cast("array<string>")))
    return candidates.withColumn("rerank", have / F.lit(max(1, len(asked)))).orderBy(F.desc("rerank"), *tie).limit(k)


def cascade(vectors: DataFrame, request: Request, query: str, text: str = "text", row_id: str = "vec_id", reranker=None, texts: DataFrame | None = None) -> DataFrame:
    """Vector candidates above the threshold, merged over libraries; first of each text; best 25 by BM25; best 5 by the reranker (else kept in order).

    texts (row_id, text): where the texts are if vectors don't carry them; it is joined with the candidates alone.
    """
    hits = by_library(vectors, request, row_id=row_id)
    position = F.row_number().over(Window.orderBy(F.desc("score"), "library_order", "hit"))
    placed = hits.withColumn("pos", position).withColumnRenamed("score", "vector_score")  # at most CANDIDATES rows
    if texts is not None:
        placed = texts.join(F.broadcast(placed), row_id)
    unique = first_of_text(placed, text, "pos").persist()  # CANDIDATES rows, read for their statistics and for their scores
    best = bm25_top(unique, query, LEXICAL, F.col("pos"), text=text)
    if reranker:
        return reranker(best, query, FINAL)
    return best.orderBy(F.desc("score"), "pos").limit(FINAL)
