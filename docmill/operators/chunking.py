"""Texts into chunks: paragraphs merged greedily by tokens and likeness, oversize parts split, payloads packed.

A document is one row and its fold stays in that row; nothing is shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import text as X
from docmill.functions import values as V
from docmill.sources.tables import bounded_batches

MIN_TOKENS, MAX_TOKENS, LIKENESS, MANY_PARAGRAPHS = 150, 1000, 0.70, 800
CHUNK_BYTES = 40_960 - 2_048
REQUEST_CHARS = int(0.9 * 2 * 1024 * 1024)
EMBED_ROWS = 96


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    parts = F.split(text, separator.replace("\n", r"\n"))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def _estimate(words: Column) -> Column:
    """Tokens of so many words."""
    return F.floor(words / F.lit(1.33)).cast("int")


def _bound(value: Column, use) -> Column:
    """use(value) with the value made once: an expression given to a lambda several times would be computed for each call of it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns made once a row, whatever uses them: expressions are not folded through a generator."""
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*names))))


def _joined(parts: Column, starts: Column, joiner: str) -> Column:
    """The parts between one start and the next, as texts; none without parts."""
    ends = F.slice(F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(parts))), F.lit(1), F.size(starts))
    return F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(parts, a + 1, b - a), joiner))


def greedy(parts: Column, low: int = MIN_TOKENS, high: int = MAX_TOKENS, joiner: str = "\n\n") -> Column:
    """Parts merged while the merged text stays within `high` tokens; a chunk still under `low` takes the next part even so.

    The fold carries the words of the chunk at hand and the places where chunks start; texts are joined once, behind it.
    """
    kind = "struct<starts: array<int>, at: int, words: int>"
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"), F.lit(0).alias("words")).cast(kind)

    def step(s: Column, n: Column) -> Column:
        grow = (s["at"] > 0) & ((_estimate(s["words"] + n) <= high) | (_estimate(s["words"]) < low))
        starts = F.when(grow, s["starts"]).otherwise(F.concat(s["starts"], F.array(s["at"])))
        return F.struct(starts.alias("starts"), (s["at"] + 1).alias("at"), (F.when(grow, s["words"]).otherwise(0) + n).alias("words")).cast(kind)

    return _bound(parts, lambda p: _joined(p, F.aggregate(F.transform(p, X.n_words), start, step, lambda s: s["starts"]), joiner))


def semantic(parts: Column, vectors: Column, low: int = MIN_TOKENS, high: int = MAX_TOKENS, likeness: float = LIKENESS, joiner: str = "\n\n") -> Column:
    """Parts merged while short, then while alike: the next part joins if the merged text stays within `high` and, once the chunk
    has `low` tokens, if its vector is like the chunk's mean.  The mean after a merge of n parts in all is (mean * n + new) / (n + 1).
    """
    kind = "struct<starts: array<int>, at: int, words: int, mean: array<double>, n: int>"
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"), F.lit(0).alias("words"), F.array().cast("array<double>").alias("mean"), F.lit(0).alias("n")).cast(kind)
    def step(s: Column, item: Column) -> Column:
        vector = item["v"]
        fits = _estimate(s["words"] + item["words"]) <= high
        alike = F.coalesce(V.cosine(s["mean"], vector), F.lit(0.0)) >= likeness
        merge = (s["n"] > 0) & fits & ((_estimate(s["words"]) < low) | alike)
        n = s["n"] + 1
        mean = F.zip_with(s["mean"], vector, lambda a, b: (a * n + b) / (n + 1))
        starts = F.when(merge, s["starts"]).otherwise(F.concat(s["starts"], F.array(s["at"])))
        words = F.when(merge, s["words"]).otherwise(0) + item["words"]
        return F.struct(starts.alias("starts"), (s["at"] + 1).alias("at"), words.alias("words"), F.when(merge, mean).otherwise(vector).alias("mean"), F.when(merge, n).otherwise(1).alias("n")).cast(kind)

    def cut(b: Column) -> Column:
        items = F.arrays_zip(F.transform(b["parts"], X.n_words).alias("words"), b["vectors"].alias("v"))
        return _joined(b["parts"], F.aggregate(items, start, step, lambda s: s["starts"]), joiner)

    return _bound(F.struct(parts.alias("parts"), vectors.alias("vectors")), cut)


def _split_text(text: str, limit: int) -> list[str]:
    out, now, size = [], [], 0
    for line in text.split("\n"):
        pieces = [line]
        if len(line.encode()) > limit:  # cut between characters
            pieces, part, n = [], [], 0
            for c in line:
                w = len(c.encode())
                if n + w > limit:
                    pieces.append("".join(part))
                    part, n = [], 0
                part.append(c)
                n += w
            pieces.append("".join(part))
        for piece in pieces:
            w = len(piece.encode()) + bool(now)
            if now and size + w > limit:
                out.append("\n".join(now))
                now, size, w = [], 0, w - 1
            now.append(piece)
            size += w
    out.append("\n".join(now))
    return [p for p in out if p.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(texts: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _split_text(t, m) for t, m in zip(texts, most, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _split_lists(lists: pd.Series, most: pd.Series) -> pd.Series:
    def one(chunks, limit: int) -> list[str]:
        return [p for c in chunks for p in ([c] if len(c.encode()) <= limit else _split_text(c, limit)) if p.strip(" ")]

    return pd.Series([None if x is None else [one(chunks, m) for chunks in x] for x, m in zip(lists, most, strict=True)], dtype=object)


def split_oversized(text: Column, most: int = CHUNK_BYTES) -> Column:
    """Parts of at most `most` bytes, cut at line ends, longer lines between characters; blank parts go, no character is lost."""
    return F.when(F.octet_length(text) <= most, F.filter(F.array(text), lambda t: F.trim(t) != "")).otherwise(_split(text, F.lit(most)))


def chunked(df: DataFrame, mode: str = "semantic", text: str = "text", separator: str = "\n\n", low: int = MIN_TOKENS, high: int = MAX_TOKENS, likeness: float = LIKENESS, most: int | None = CHUNK_BYTES, vectors=V.hashed_vectors) -> DataFrame:
    """df exploded into (…, ordinal, chunk).  mode: semantic (token rule alone above 800 paragraphs), greedy, or whole.  Chunks above `most` bytes are split; with None by the mode's rule alone."""
    # Columns of their own, so that neither is made twice.
    df = df.withColumn("__parts", paragraphs(F.col(text), separator))
    parts, joiner = F.col("__parts"), separator
    if mode == "whole":
        chunks = F.filter(F.array(F.col(text)), lambda t: F.trim(t) != "")
    elif mode == "greedy":
        chunks = greedy(parts, low, high, joiner)
    else:
        bounded_batches(df.sparkSession)
        df = df.withColumn("__vectors", vectors(parts))
        chunks = _merged(parts, F.col("__vectors"), low, high, likeness, joiner)
    keys = [c for c in df.columns if c not in (text, "__parts", "__vectors")]
    whole = df.select(*keys, F.posexplode(chunks).alias("merged", "part"))
    cut = whole.select(*[c for c in whole.columns if c != "part"], F.posexplode(F.array("part") if most is None else split_oversized(F.col("part"), most)).alias("cut", "chunk"))
    if not keys:
        return cut.select("merged", "cut", "chunk")
    before = F.row_number().over(Window.partitionBy(*keys).orderBy("merged", "cut")) - 1
    return cut.select(*keys, before.alias("ordinal"), "chunk")


def _merged(parts: Column, vectors: Column, low: int, high: int, likeness: float, joiner: str) -> Column:
    alike = semantic(parts, vectors, low, high, likeness, joiner)
    return F.when(F.size(parts) <= 1, parts).when(F.size(parts) > MANY_PARAGRAPHS, greedy(parts, low, high, joiner)).otherwise(alike)


def chunk_lists(df: DataFrame, texts: str, mode: str = "semantic", separator: str = "\n\n", low: int = MIN_TOKENS, high: int = MAX_TOKENS, likeness: float = LIKENESS, most: int | None = CHUNK_BYTES, vectors=V.hashed_vectors) -> DataFrame:
    """df with `chunks`, a list for each of the array `texts`, cut as chunked() cuts one text; rows stay whole, so that nothing is shuffled."""
    if mode == "whole":
        df = df.withColumn("chunks", F.transform(texts, lambda t: F.filter(F.array(t), lambda c: F.trim(c) != "")))
    else:
        df = once(df.withColumn("__parts", F.transform(texts, lambda t: F.coalesce(paragraphs(t, separator), F.array().cast("array<string>")))), "__parts")
        if mode == "greedy":
            chunks = F.transform("__parts", lambda p: greedy(p, low, high, separator))
        else:
            bounded_batches(df.sparkSession)
            df = once(df.withColumn("__vectors", vectors(F.flatten("__parts"))), "__vectors")
            before = lambda i: F.aggregate(F.slice("__parts", F.lit(1), i), F.lit(0), lambda n, p: n + F.size(p))
            chunks = F.transform("__parts", lambda p, i: _merged(p, F.slice("__vectors", before(i) + 1, F.size(p)), low, high, likeness, separator))
        df = df.withColumn("chunks", chunks).drop("__parts", "__vectors")
    df = once(df, "chunks")
    if most is None:
        return df
    # Python sees the texts that have a chunk too long.
    long = F.exists("chunks", lambda chunks: F.exists(chunks, lambda c: F.octet_length(c) > most))
    fitting = F.transform("chunks", lambda chunks: F.filter(chunks, lambda c: F.trim(c) != ""))
    return once(df.withColumn("chunks", F.when(long, _split_lists(F.when(long, F.col("chunks")), F.lit(most))).otherwise(fitting)), "chunks")


def packed(sizes: Column, most: int = REQUEST_CHARS) -> Column:
    """The batch number of each size of an ordered array: a batch is full before it would pass `most`; one larger alone is a batch."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).cast("long").alias("sum"))

    def step(s: Column, size: Column) -> Column:
        full = (s["sum"] > 0) & (s["sum"] + size > most)
        batch = s["batch"] + F.when(full, 1).otherwise(0)
        return F.struct(F.concat(s["out"], F.array(batch)).alias("out"), batch.alias("batch"), (F.when(full, F.lit(0)).otherwise(s["sum"]) + size).cast("long").alias("sum"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def fixed_batches(df: DataFrame, key: str, *order: str, rows: int = EMBED_ROWS) -> DataFrame:
    """df with the number of its batch of `rows` rows within each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("batch", F.floor((n - 1) / rows).cast("int"))


def with_ids(chunks: DataFrame, path: str, page: str, ordinal: str = "ordinal") -> DataFrame:
    return chunks.withColumn("chunk_id", X.chunk_id(F.col(path), F.col(page), F.col(ordinal)))
