"""Language identification by string kernels.

A text is the set of byte n-grams (1 to 3) it contains; the kernel of two texts is the number
of n-grams they share over the geometric mean of their own numbers.  Landmarks of every language
span a Nyström approximation of that kernel, and kernel ridge regression in it gives one linear
function per language, one against the rest.  Landmarks and coefficients multiply to one weight for
each n-gram and language, so a batch of texts is scored by the product of its sparse presence
matrix with those weights.

Fitting reads a bounded sample of the labelled rows: at most TRAIN_ROWS distinct texts of each language and
SAMPLE_BYTES in all, of longer texts the first TRAIN_CHARS characters.  They are drawn by hash of text with a
chance from the number of a language's distinct texts, wide enough that a language with few texts, or with
few repeated over many rows, gives all of them, and none is lost; repeated texts are dropped before they leave the
tasks.  LANDMARKS of each language, LANDMARKS_IN_ALL together (one of each at least).  The number of languages
isn't bounded, but their weights are (MODEL_BYTES; more is refused).  Scoring reads every text whole;
each row is independent, so nothing is shuffled.

Defined cases: a null text, or one without a letter, is `und` with score 0, and so is every text
where no language could be learned; rows without a language are never learned from; a null id
counts as the empty text; texts of any length are read whole; repeated rows give equal rows; ties go to the language that sorts
first; an empty table gives an empty result; extra columns pass through, those named like a
result are replaced.
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
from docmill.llm.shared import bounded_batches, written

ORDERS = (1, 2, 3)
TRAIN_ROWS, LANDMARKS, TRAIN_CHARS = 300, 40, 8192
SAMPLE_BYTES, LANDMARKS_IN_ALL, MODEL_BYTES = 128 << 20, 2000, 256 << 20
#: Texts drawn for each one wanted, and for each language besides: the draw falls short of what is wanted with a chance below 10^-12.
DRAWN, MORE = 2, 40
#: Labels whose chances are sent to all tasks; with more, texts are joined by a shuffle.
SENT_LABELS = 100_000
RIDGE = 1e-3
#: Numbers of a matrix held at once.
CELLS = 1 << 23


def presence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram of every text once: rows, ascending, and codes (order and bytes)."""
    data = A.LOWER[data].astype(np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    keys = []
    code = np.zeros(len(data), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = max(0, len(data) - n + 1)
        code = (code[:m] << np.uint64(8)) | data[n - 1 :]
        if n in ORDERS:
            inside = row[:m] == row[n - 1 :]
            keys.append(np.unique(((row[:m] << np.uint64(26)) | np.uint64(n << 24) | code)[inside]))
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    return (keys >> np.uint64(26)).astype(np.int64), (keys & np.uint64((1 << 26) - 1)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # codes, ascending
    weights: np.ndarray  # vocabulary x languages

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, code = presence(data, offsets)
        own = np.maximum(np.bincount(row, minlength=n), 1)
        at = np.minimum(np.searchsorted(self.vocabulary, code), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == code
        row, at = row[known], at[known]
        out = np.zeros((n, len(self.languages)))
        step = max(1, CELLS // len(self.languages))
        for first in range(0, len(row), step):
            part = slice(first, first + step)
            starts = np.flatnonzero(np.diff(row[part], prepend=-1))
            out[row[part][starts]] += np.add.reduceat(self.weights[at[part]], starts, axis=0)
        return out / np.sqrt(own)[:, None]


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def kernel(one: list[str], two: list[str]) -> np.ndarray:
    """Shared n-grams over the geometric mean of both numbers, a slice of the vocabulary at a time."""
    (row, code), (other, theirs) = presence(*packed(one)), presence(*packed(two))
    vocabulary = np.unique(theirs)
    step = max(1, CELLS // max(1, len(one) + len(two)))
    out = np.zeros((len(one), len(two)))
    by, from_ = np.argsort(code, kind="stable"), np.argsort(theirs, kind="stable")
    for first in range(0, len(vocabulary), step):
        part = vocabulary[first : first + step]
        sides = []
        for n, rows, codes, order in ((len(one), row, code, by), (len(two), other, theirs, from_)):
            cut = order[np.searchsorted(codes[order], part[0]) : np.searchsorted(codes[order], part[-1], "right")]
            at = np.minimum(np.searchsorted(part, codes[cut]), len(part) - 1)
            known = part[at] == codes[cut]
            side = np.zeros((n, len(part)), np.float32)
            side[rows[cut][known], at[known]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    size = lambda rows, n: np.maximum(np.bincount(rows, minlength=n), 1)
    return out / np.sqrt(size(row, len(one))[:, None] * size(other, len(two)))


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """texts in any fixed order; the first `landmarks` of each label are its landmarks."""
    if not texts:
        return None
    languages, label, counts = np.unique(np.array(labels, object), return_inverse=True, return_counts=True)
    landmarks = min(landmarks, max(1, LANDMARKS_IN_ALL // len(languages)))
    order = np.argsort(label, kind="stable")
    nth = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    chosen = [texts[i] for i in order[nth < landmarks]]
    between = kernel(chosen, chosen)
    value, vector = np.linalg.eigh((between + between.T) / 2)
    keep = value > 1e-6 * max(value.max(), 1e-12)
    nystrom = vector[:, keep] / np.sqrt(value[keep])
    features = kernel(texts, chosen) @ nystrom
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Languages count alike, however many rows each has.
    weight = 1 / counts[label].astype(float)[:, None]
    gram = features.T @ (features * weight) + ridge * np.eye(features.shape[1])
    coefficients = nystrom @ np.linalg.solve(gram, features.T @ (target * weight))
    row, code = presence(*packed(chosen))
    vocabulary, at = np.unique(code, return_inverse=True)
    if not len(vocabulary):
        vocabulary, row, at = np.array([-1]), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if (size := 8 * len(vocabulary) * len(languages)) > MODEL_BYTES:
        raise ValueError(f"weights of {size} bytes, which every task gets, are bounded by {MODEL_BYTES}; take fewer landmarks")
    own = np.maximum(np.bincount(row, minlength=len(chosen)), 1)
    weights = np.zeros((len(vocabulary), len(languages)))
    for k in range(len(languages)):
        weights[:, k] = np.bincount(at, (coefficients[:, k] / np.sqrt(own))[row], minlength=len(vocabulary))
    return Model(languages.tolist(), vocabulary, weights)


def training_rows(df: DataFrame, text: str, label: str, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """Distinct texts (their first `chars` characters) of each label, drawn by hash: about DRAWN * `rows` + MORE, or all where there are fewer; columns label, text and h.

    Distinct texts are counted first, by sketches that are merged.
    """
    own = df.select(F.left(F.col(f"`{text}`"), F.lit(chars)).alias("text"), F.col(f"`{label}`").cast("string").alias("label"))
    fits = own.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    counts = fits.groupBy("label").agg(F.approx_count_distinct("h").alias("n"))
    # One row a label, written so that their number is known before the texts are joined: those aren't moved.
    counts, _ = written(counts, "labels")
    chances = counts.select(F.col("label").alias("__lang"), F.least(F.lit(1.0), F.lit(float(DRAWN * rows + MORE)) / F.col("n")).alias("chance"))
    chances = F.broadcast(chances) if counts.count() <= SENT_LABELS else chances
    drawn = fits.join(chances, F.col("label") == F.col("__lang")).where(F.pmod("h", F.lit(1 << 30)) < F.col("chance") * float(1 << 30))
    return drawn.select("label", "text", "h").dropDuplicates(["label", "h"])


def trained(df: DataFrame, text: str = "text", label: str = "lang", rows: int = TRAIN_ROWS, **kw) -> Model | None:
    n = max(1, df.where(F.col(f"`{label}`").isNotNull()).select(F.count_distinct(F.col(f"`{label}`").cast("string"))).first()[0])
    rows = max(1, min(rows, SAMPLE_BYTES // (DRAWN * 4096 * n)))
    chars = max(64, min(TRAIN_CHARS, SAMPLE_BYTES // (4 * (DRAWN * rows + MORE) * n)))
    found, last, taken = [], None, 0
    for y, h, t in sorted((r["label"], r["h"], r["text"]) for r in training_rows(df, text, label, rows, chars).toLocalIterator()):
        last, taken = y, taken + 1 if y == last else 1
        if taken <= rows:
            found.append((y, t))
    return fit([t for _, t in found], [y for y, _ in found], **kw)


def identified(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    names = ["lang_pred", "score"]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    letter: Column = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias("__lang_letter")
    own = F.col(f"`{text}`").alias("__lang_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            at = batch.schema.get_field_index
            letters = batch.column(at("__lang_letter")).to_numpy(zero_copy_only=False)
            if model is None:
                best, score = np.zeros(len(letters), int), np.zeros(len(letters))
            else:
                got = np.concatenate([model.scores(d, o) for _, _, d, o in A.blocks(batch.column(at("__lang_text")))] or [np.zeros((0, len(model.languages)))])
                best = got.argmax(axis=1) if len(got) else np.zeros(0, int)
                score = np.clip((1 + got.max(axis=1, initial=-1).astype(float)) / 2, 0, 1)
                letters = letters.astype(bool)
            known = letters.astype(bool) & (model is not None)
            lang = np.array([*(model.languages if model else []), "und"], object)[np.where(known, best, -1)]
            new = [pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0))]
            yield pa.RecordBatch.from_arrays([batch.column(at(c)) for c in kept] + new, names=kept + names)

    return df.select(*[F.col(f"`{c}`") for c in kept], own, letter).mapInArrow(run, schema)


def held_out(row_id: Column) -> Column:
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit(""))) % 5 == 0


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = trained(docs.where(~held_out(F.col("doc_id"))))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
