"""Token counts of whole texts by a two-tier lookup, without moving a pre-token.

Byte-level BPE splits a text before every space that a non-space follows, whatever stands around
it, so the token count of a text is the sum over such pieces.  Tier one is a compact table of
frequent pieces and their token counts, broadcast once; tier two is a cache in every Python
worker, filled by encoding the pieces that both miss, a batch at a time.  Both are bounded
(TABLE_PIECES, CACHE_PIECES).  Which pieces the table holds is chosen from the beginnings of the
first SAMPLE_ROWS rows at hand; their counts come from the tokenizer and what the table lacks goes to the
second tier, so this choice changes speed alone.  Texts are read once, and no piece is moved.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special strings inside a text
count as the one token that the library's default makes of them; texts of any length are read
whole, a piece without spaces is encoded in one go; repeated rows give equal rows; an empty
table gives an empty result; extra columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.shared import bounded_batches

SAMPLE_ROWS, SAMPLE_CHARS = 4096, 8192
TABLE_PIECES = 1 << 16
CACHE_PIECES = 1 << 18
#: Bytes of texts cut into pieces at a time.
TEXT_BYTES = 1 << 19
#: Pieces encoded by one call.
ENCODED = 1 << 12
#: Longer pieces are encoded anew each time, so that the caches stay bounded in bytes too.
CACHED_CHARS = 64
#: Unicode White_Space, which the tokenizers' pattern means by \s; Python's own \s has more.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNSAFE = re.compile(f" (?:[{_WHITE}]|$)")
_EDGE = re.compile(f"(?= [^{_WHITE}])")


def pieces(text: str) -> list[str]:
    """The text cut before every space that a non-space follows; concatenated, they are the text.

    >>> pieces("a  b c")
    ['a ', ' b', ' c']
    """
    if _UNSAFE.search(text):
        return [p for p in _EDGE.split(text) if p]
    first, *rest = text.split(" ")
    return [p for p in (first, *[" " + p for p in rest]) if p]


@dataclass(frozen=True)
class Table:
    """Frequent pieces, joined by NUL, and their counts."""

    joined: bytes
    counts: bytes

    @staticmethod
    def of(counts: dict[str, int]) -> Table:
        fits = {p: n for p, n in counts.items() if n < 256 and "\0" not in p}
        return Table("\0".join(fits).encode(), bytes(fits.values()))

    def read(self) -> dict[str, int]:
        return dict(zip(self.joined.decode().split("\0"), self.counts, strict=True)) if self.counts else {}


class Encoder:
    """Token counts by a tokenizers file, its special strings being one token each as by the library's default."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for at in range(0, len(texts), ENCODED) for e in self.library.encode_batch_fast(texts[at : at + ENCODED], add_special_tokens=False)]


class Counts:
    """A worker's two tiers."""

    def __init__(self, path: str, table: Table) -> None:
        self.encoder, self.frequent, self.cache = Encoder(path), table.read(), {}

    def of(self, texts: Iterable[str]) -> list[int]:
        cut: list[list[str]] = []
        whole: list[tuple[int, int]] = []  # (row, parts) of texts without special strings are the common case
        extra: list[int] = []
        for text in texts:
            special = self.encoder.special.findall(text) if self.encoder.special else ()
            parts = self.encoder.special.split(text) if special else (text,)
            whole.append((len(cut), len(parts)))
            extra.append(len(special))
            cut.extend(pieces(p) for p in parts)
        known = self.frequent
        missed = set().union(*cut).difference(known)
        fresh = missed.difference(self.cache)
        if len(self.cache) + len(fresh) > CACHE_PIECES:
            self.cache = {}
            fresh = missed
        order = list(fresh)
        counted = dict(zip(order, self.encoder.counts(order), strict=True))
        self.cache.update((p, n) for p, n in counted.items() if len(p) <= CACHED_CHARS and len(self.cache) < CACHE_PIECES)
        lookup = _Chain(known)
        lookup.rest = (self.cache, counted)
        sums = [sum(map(lookup.__getitem__, row)) for row in cut]
        return [sum(sums[at : at + n]) + more for (at, n), more in zip(whole, extra, strict=True)]


_WORKER: dict[tuple[str, int], Counts] = {}


def _worker(path: str, table: Table) -> Counts:
    """This Python worker's tiers, kept from task to task."""
    at = (path, hash(table))
    if at not in _WORKER:
        _WORKER.clear()
        _WORKER[at] = Counts(path, table)
    return _WORKER[at]


class _Chain(dict):
    """Tier one, then tier two."""

    rest: tuple[dict[str, int], dict[str, int]] = ({}, {})

    def __missing__(self, piece: str) -> int:
        cache, counted = self.rest
        n = cache.get(piece)
        return counted[piece] if n is None else n


def frequent_table(df: DataFrame, text: str, path: str, sample_rows: int = SAMPLE_ROWS, size: int = TABLE_PIECES) -> Table:
    """Counts of the most frequent pieces in the first sample_rows rows, SAMPLE_CHARS of each: Spark reads as few partitions as hold them."""
    sample = df.select(F.left(F.col(f"`{text}`"), F.lit(SAMPLE_CHARS)).alias("text")).where("text IS NOT NULL").take(sample_rows)
    seen: Counter[str] = Counter()
    for row in sample:
        seen.update(pieces(row["text"]))
    found = [p for p, n in seen.most_common(size) if n > 1 and len(p) <= CACHED_CHARS]
    return Table.of(dict(zip(found, Encoder(path).counts(found), strict=True)))


def counted(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 512) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit of its text column, by the tokenizers file at path `tokenizer`."""
    bounded_batches(df.sparkSession)
    names = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    table = df.sparkSession.sparkContext.broadcast(frequent_table(df, text, tokenizer))
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _worker(tokenizer, table.value)
        for batch in batches:
            column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
            n_bytes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            n_tokens: list[int] = []
            at, ends = 0, np.cumsum(n_bytes)
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right")))
                n_tokens += counts.of(column.slice(at, to - at).to_pylist())
                at = to
            tokens = np.array(n_tokens, np.int64)
            new = [pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + new, names=kept + names)

    return df.mapInArrow(run, schema)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return counted(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
