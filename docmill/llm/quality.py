"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text.  A row of the ledger keeps the measurements and one
integer whose bit k says that rule k failed.  A policy is a named, versioned set of rules, so
that a new policy, or the question what a single rule costs, is a bitwise expression over the
ledger and never a new reading of the texts.

Defined cases: a null or empty text has no words and fails `few_words`; repeated rows are
judged alike, one result row for each; null ids and all other columns pass through untouched;
an empty table gives an empty ledger.  Ledger columns take a prefix, so that input columns of
the same name survive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm import arrays as A
from docmill.llm.shared import bounded_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


@dataclass(frozen=True)
class Rule:
    """fails: a SQL condition over the measurements."""

    name: str
    fails: str


#: Bit k of the ledger is rule k.  Rules are only ever appended, so old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule("shouting", "2 * n_upper > n_letters"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self) -> int:
        names = [r.name for r in RULES]
        return sum(1 << names.index(x) for x in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (BASE, Policy("prose-1", tuple(r.name for r in RULES)))}
CURRENT = POLICIES["prose-1"]


def measure_block(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each text of a block of UTF-8 bytes."""
    words = A.Words(data, offsets, A.SPACED, lower=False)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
    out = {
        "n_words": words.counts,
        "word_chars": total(A.SPACED[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": total(_SYMBOL[data]),
        "n_letters": total(_LETTER[data]),
        "n_upper": total(_UPPER[data]),
    }
    starts, ends = A.spans(data != 10, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, row = starts[full], ends[full], row[full]
    keys = A.mix(A.string_hash(data, starts, ends) + row.astype(np.uint64) * A._GOLD)
    later = np.ones(len(keys), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    rows = len(offsets) - 1
    out["n_lines"] = np.bincount(row, minlength=rows)
    out["n_dup_lines"] = np.bincount(row[later], minlength=rows)
    at = A.full_windows(words, 3)
    keys = A.mix(A.window_hash(words.hashes, 3)[at] + words.row[at].astype(np.uint64) * A._GOLD)
    inside = A.covered(at[A.repeated(keys)], 3, len(words.row))
    out["n_repeat_words"] = np.bincount(words.row[inside], minlength=rows)
    return out


def measured(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """df with the measurements of its text column, each named prefix + its name; a column of df with such a name is replaced."""
    bounded_batches(df.sparkSession)
    names = [prefix + m for m in MEASURES]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T.LongType()) for n in names])
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            parts = [measure_block(data, offsets) for _, _, data, offsets in A.blocks(column)]
            if parts:
                new = [pa.array(np.concatenate([p[m] for p in parts]).astype(np.int64)) for m in MEASURES]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + new, names=kept + names)

    return df.mapInArrow(run, schema)


def ledger(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """df with its measurements and the failure bits of all RULES, in prefix + `fail_bits`."""
    out = measured(df, text, prefix)

    def bit(k: int, rule: Rule) -> Column:
        sql = rule.fails
        for m in MEASURES if prefix else ():
            sql = sql.replace(m, f"`{prefix}{m}`")
        return F.when(F.expr(sql), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")

    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(bit(k, rule))
    return out.withColumn(prefix + "fail_bits", bits)


def passes(policy: Policy, prefix: str = "") -> Column:
    return F.col(prefix + "fail_bits").bitwiseAND(F.lit(policy.mask()).cast("long")) == 0


def ablation(book: DataFrame, policy: Policy, prefix: str = "") -> DataFrame:
    """For each rule of the policy: how many rows fail it, and how many of them would be kept without it."""
    bits = F.col(prefix + "fail_bits").bitwiseAND(F.lit(policy.mask()).cast("long"))
    counts = book.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))  # at most 2^rules rows
    rules = [(k, r.name) for k, r in enumerate(RULES) if r.name in policy.rules]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, n in rules])).alias("r")
    failed = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        counts.select("bits", "n", each)
        .groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).cast("long").alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).cast("long").alias("n_failed_alone"),
        )
    )


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(BASE)).alias("base_failed"), passes(CURRENT).alias("kept"), "fail_bits",
    )


#: Ledger of `documents` in SQL, kept as a fragment for the pipeline's statement.
LEDGER_SQL = r"""
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {table}),
ws AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM ws),
wins AS (SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS win FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM wins WHERE win IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM docs),
m AS (
  SELECT ws.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM ws JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
ledger AS (
  SELECT *, ((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) | (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    | (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) | (CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END)
    | (CASE WHEN 2 * n_upper > n_letters THEN 16 ELSE 0 END)
    | (CASE WHEN word_chars < 3 * n_words OR word_chars > 10 * n_words THEN 32 ELSE 0 END))::BIGINT AS fail_bits
  FROM m)
"""

SQL = (
    "WITH " + LEDGER_SQL.format(table="documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM ledger"""
)
