"""Benchmark decontamination with suffix arrays of the training texts.

A window is ten words, or a whole item of fewer.  Every task first looks which of its texts hold a
window of the test set at all: the hashes of their own windows go through a bit table and a binary search
among the test set's, and what is found is compared word by word.  Texts without any are done.  The others,
SHARD_WORDS of them at a time, make a shard: a suffix array by Larsson-Sadakane refinement of
their words together with the items whose windows they hold.  In its order every place of a
text stands next to the test suffixes that agree with it longest; the ranks of the refinement tell
in how many words, a binary search finds all suffixes that agree so far, and the first of the test set among
them is named.  So a match costs what the words of texts and items cost, times a logarithm, however long it is,
however often its words repeat and however large the rest of the test set is.  Shards are independent: no
document is moved, no index is kept.

The test set is read in slices of at most SLICE_BYTES, each sent to all tasks once its size is
known; a larger set takes more slices, one pass after the other over the same task's rows.

Defined cases: null texts have no words, match nothing and aren't contaminated; an item without
words has no window; items with one id count as one item, a null id is called `null`; texts of any
length are read whole, one longer than a shard being one; of equally long matches at a place the
item first by id and place is named; repeated rows give equal rows; empty tables give an empty
result or no match; extra columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm import arrays as A
from docmill.llm.shared import bounded_batches
from docmill.llm.suffixes import agreement, ranked

WINDOW = 10
SLICE_BYTES = 16 << 20
#: Words of the texts with a window that make a shard; a text with more is one.
SHARD_WORDS = 1 << 20
#: Bits of a hash that the table of windows is indexed by, where the test set is large.
TABLE_BITS = 24
MATCH = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType())]))


class TestSet:
    """All words of a slice of the test set, its windows by hash, and which items hold each."""

    __test__ = False

    def __init__(self, ids: list[str], texts: pa.Array, window: int = WINDOW) -> None:
        #: In the order of ids, so that the first of several items is the first by id.
        order = sorted(range(len(ids)), key=ids.__getitem__)
        self.ids, self.size = sorted(set(ids)), window
        number = {x: k for k, x in enumerate(self.ids)}
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in A.blocks(texts.take(pa.array(order, pa.int64()))):
            words = A.Words(data, offsets, A.ALNUM, lower=True)
            hashes.append(words.hashes)
            counts.append(words.counts)
        self.word, counts = np.concatenate(hashes), np.concatenate(counts)
        n = len(self.word)
        #: Texts of items: item of each, first word, words.
        self.item, self.first, self.counts = np.array([number[ids[i]] for i in order], np.int64), np.cumsum(counts) - counts, counts
        self.text = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(n) - self.first[self.text]
        room = counts[self.text] - self.place
        need = np.where(room >= window, window, np.where((self.place == 0) & (counts[self.text] < window), room, 0))
        #: By number of words: sorted hashes of windows, where each first stands, a bit table, and the number of the first.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]] = {}
        pairs, total = [np.zeros((2, 0), np.int64)], 0
        for m in np.unique(need[need > 0]).tolist():
            starts = np.flatnonzero(need == m)
            known, at, which = np.unique(A.window_hash(self.word, m)[starts], return_index=True, return_inverse=True)
            bits = min(TABLE_BITS, max(8, int(len(known)).bit_length() + 5))
            table = np.zeros(1 << bits, bool)
            table[known >> np.uint64(64 - bits)] = True
            self.windows[m] = known, starts[at], table, total
            pairs.append(np.stack([which + total, self.text[starts]]))
            total += len(known)
        #: texts_of[bounds[w]:bounds[w + 1]] hold window w.
        pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
        self.bounds, self.texts_of = np.searchsorted(pairs[0], np.arange(total + 1)), pairs[1]

    def held(self, words: A.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where a block of texts holds windows: place, words, number of the window, where the test set first has it."""
        out = []
        for m, (known, first, table, number) in self.windows.items():
            at = A.full_windows(words, m)
            key = A.window_hash(words.hashes, m)[at]
            maybe = table[key >> np.uint64(64 - (len(table).bit_length() - 1))]
            at, key = at[maybe], key[maybe]
            w = np.minimum(np.searchsorted(known, key), len(known) - 1)
            same = known[w] == key
            at, w = at[same], w[same]
            for k in range(m):
                same = words.hashes[at + k] == self.word[first[w] + k]
                at, w = at[same], w[same]
            out.append((at, np.full(len(at), m), w + number, first[w]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges, the number of the range and every place in it."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class Shard:
    """The suffix array of the words of some texts, and of the test set's texts whose windows they hold."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, test: TestSet, texts: np.ndarray) -> None:
        self.test = test
        own = test.counts[texts]
        _, self.origin = _expanded(test.first[texts], test.first[texts] + own)  # where the test set has each of its words here
        self.n = len(self.origin)
        _, symbols = np.unique(np.concatenate([test.word[self.origin], words]), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([own, counts]))])
        self.end = np.repeat(bounds[1:], np.diff(bounds))
        self.order, self.ranks = ranked(symbols, bounds, int(own.max(initial=0)))
        self.at = np.empty_like(self.order)
        self.at[self.order] = np.arange(len(self.order))
        room = np.concatenate([np.arange(c, 0, -1) for c in own.tolist()]) if len(own) else np.zeros(0, np.int64)
        asks = np.zeros(len(self.order), bool)
        asks[: self.n] = room >= test.size
        self.asks = asks[self.order]

    def longest(self, places: np.ndarray) -> np.ndarray:
        """In how many words each place agrees with the test suffix that agrees longest: one of its neighbours in order."""
        n = len(self.order)
        index = np.arange(n)
        before = np.maximum.accumulate(np.where(self.asks, index, -1))
        after = np.minimum.accumulate(np.where(self.asks, index, n)[::-1])[::-1]
        own, size = places + self.n, np.zeros(len(places), np.int64)
        for near in (before[self.at[own]], after[self.at[own]]):
            real = (near >= 0) & (near < n)
            size[real] = np.maximum(size[real], agreement(self.ranks, self.end, own[real], self.order[near[real]]))
        return size

    def _same(self, i: np.ndarray, own: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the suffix at place i of the order agrees with `own` in `size` words: by two overlapping powers of two."""
        k = np.frexp(size.astype(np.float64))[1] - 1
        rest, last = size - (1 << k), len(self.order) - 1
        x = self.order[i]
        same = (x + rest <= last) & (self.ranks[k, x] == self.ranks[k, own])
        return same & (self.ranks[k, np.minimum(x + rest, last)] == self.ranks[k, own + rest])

    def first_of(self, places: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first word in the test set from where it agrees with each place in `size` words."""
        own = places + self.n
        at = self.at[own]
        ends = []
        for step, far in ((-1, np.zeros_like(at)), (1, np.full_like(at, len(self.order) - 1))):
            near = at.copy()  # agrees; what lies beyond `far` doesn't
            while (todo := np.flatnonzero(near != far)).size:
                mid = near[todo] + step * ((np.abs(far[todo] - near[todo]) + 1) // 2)
                good = self._same(mid, own[todo], size[todo])
                near[todo[good]] = mid[good]
                far[todo[~good]] = mid[~good] - step
            ends.append(near)
        # Minima of ranges of test suffixes: of two overlapping powers of two.
        low = np.append(0, np.cumsum(self.asks))
        a, b = low[ends[0]], low[ends[1] + 1]
        levels = [self.origin[self.order[self.asks]]]
        while 1 << len(levels) <= len(levels[0]):
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for level in np.unique(k).tolist():
            some = k == level
            out[some] = np.minimum(levels[level][a[some]], levels[level][b[some] - (1 << level)])
        return out


class Matcher:
    """Longest matches of the texts of one batch."""

    def __init__(self, test: TestSet) -> None:
        self.test = test
        self.rows = 0
        self.counts: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.matches: list[list[dict]] = []
        self.items: list[list[str]] = []
        self._empty()

    def _empty(self) -> None:
        self.words: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.of: list[np.ndarray] = []
        self.hits: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """A block of texts: those with a window are put aside for the shard."""
        words = A.Words(data, offsets, A.ALNUM, lower=True)
        self.counts.append(words.counts)
        self.matches += [[] for _ in range(words.rows)]
        self.items += [[] for _ in range(words.rows)]
        at, size, window, first = self.test.held(words)
        if len(at):
            rows, which = np.unique(words.row[at], return_inverse=True)
            _, taken = _expanded(words.first[rows], words.first[rows + 1])
            counts = words.counts[rows]
            begins = np.cumsum(counts) - counts
            self.hits.append((at - words.first[rows][which] + begins[which] + self.n, size, window, first))
            self.words.append(words.hashes[taken])
            self.sizes.append(counts)
            self.of.append(rows + self.rows)
            self.n += len(taken)
            if self.n >= SHARD_WORDS:
                self.flush()
        self.rows += words.rows

    def flush(self) -> None:
        if not self.hits:
            return
        test = self.test
        words, counts, of = np.concatenate(self.words), np.concatenate(self.sizes), np.concatenate(self.of)
        at, size, window, first = (np.concatenate(c) for c in zip(*self.hits, strict=True))
        begins = np.cumsum(counts) - counts
        text = np.searchsorted(begins, at, "right") - 1
        # Items by text and window.
        pairs = np.unique(np.stack([text, window]), axis=1)
        which, entry = _expanded(test.bounds[pairs[1]], test.bounds[pairs[1] + 1])
        held = np.unique(np.stack([pairs[0][which], test.item[test.texts_of[entry]]]), axis=1)
        for r, i in held.T.tolist():
            self.items[of[r]].append(test.ids[i])
        # The longest match at each place with a window; where only whole short items stand, the longest of them.
        by = np.lexsort((first, -size, at))
        lead = np.append(True, at[by][1:] != at[by][:-1])
        at, size, window, first = (x[by][lead] for x in (at, size, window, first))
        full = np.flatnonzero(size == test.size)
        shard = None
        if len(full):
            used = np.unique(window[full])
            _, entry = _expanded(test.bounds[used], test.bounds[used + 1])
            shard = Shard(words, counts, test, np.unique(test.texts_of[entry]))
            size[full] = shard.longest(at[full])
        # Ends never pass a text's end: a match that ends where an earlier one does, or before, lies inside it.
        reach = np.maximum.accumulate(at + size)
        keep = np.append(True, (at + size)[1:] > reach[:-1])
        at, size, first = at[keep], size[keep], first[keep]
        full = np.flatnonzero(size >= test.size)
        if shard is not None and len(full):
            first[full] = shard.first_of(at[full], size[full])
        text = np.searchsorted(begins, at, "right") - 1
        for r, p, n, t in zip(of[text].tolist(), (at - begins[text]).tolist(), size.tolist(), first.tolist(), strict=True):
            self.matches[r].append({"first_word": p, "n_words": n, "item_id": test.ids[test.item[test.text[t]]], "item_word": int(test.place[t])})
        self._empty()


def test_slices(bench: DataFrame, item_id: str, text: str, slice_bytes: int = SLICE_BYTES) -> Iterator[TestSet]:
    """The test set, a slice at a time; its size is measured first."""
    items = bench.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // slice_bytes))
    for k in range(n):
        part = (items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)).toArrow()
        yield TestSet(part.column(0).to_pylist(), part.column(1).combine_chunks())


def covered_words(matches: Column) -> Column:
    """Words inside any of the matches."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def step(s: Column, m: Column) -> Column:
        end = m["first_word"] + m["n_words"]
        return F.struct((s["n"] + F.greatest(F.lit(0), end - F.greatest(s["to"], m["first_word"]))).alias("n"), F.greatest(s["to"], end).alias("to"))

    return F.aggregate(F.array_sort(matches), start, step, lambda s: s["n"])


def matched(df: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """df with n_words, n_hit (words inside a match), matches (first_word, n_words, item_id, item_word), items (sorted ids) and contaminated."""
    names = ["n_words", "n_hit", "matches", "items", "contaminated"]
    kept = [c for c in df.columns if c not in names]
    own = "__leak_text" if text in names else text
    out = df.select(*[F.col(f"`{c}`") for c in kept], *([F.col(f"`{text}`").alias(own)] if own not in kept else []), F.lit(0).cast("long").alias("n_words"), F.array().cast(MATCH).alias("matches"), F.array().cast("array<string>").alias("items"))
    spark = df.sparkSession
    bounded_batches(spark)
    for test in test_slices(bench, item_id, item_text, slice_bytes):
        sent = spark.sparkContext.broadcast(test)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            kinds = {"matches": pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64())])), "items": pa.list_(pa.string())}
            for batch in batches:
                matcher = Matcher(sent.value)
                for _, _, data, offsets in A.blocks(batch.column(batch.schema.get_field_index(own))):
                    matcher.add(data, offsets)
                matcher.flush()
                found = {"matches": matcher.matches, "items": matcher.items}
                new = {"n_words": pa.array(np.concatenate(matcher.counts))}
                for c, kind in kinds.items():
                    before = batch.column(batch.schema.get_field_index(c)).to_pylist()
                    new[c] = pa.array([a + b if a else b for a, b in zip(before, found[c], strict=True)], kind)
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], names=batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out.select(
        *[F.col(f"`{c}`") for c in kept], "n_words", covered_words(F.col("matches")).alias("n_hit"), "matches", F.array_sort(F.array_distinct("items")).alias("items"), (F.size("matches") > 0).alias("contaminated"),
    )


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return matched(docs, bench).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


#: Expects `docs` (rid, text); gives `leaks` (rid, n_words, n_hit, items).
LEAKS_SQL = r"""
dw AS (SELECT rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs),
bw AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, len(w) - m + 1)) AS i FROM (SELECT *, least(10, len(w)) AS m FROM bw WHERE len(w) > 0))),
dwin AS (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT rid, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM dw, (SELECT DISTINCT m FROM bwin) WHERE len(w) >= m)),
found AS (SELECT rid, i, m, item_id FROM dwin JOIN bwin USING (m, win)),
inside AS (SELECT rid, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + m - 1)) AS j FROM found) GROUP BY rid),
listed AS (SELECT rid, list_sort(list_distinct(list(item_id))) AS items FROM found GROUP BY rid),
leaks AS (SELECT rid, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(items, []) AS items FROM dw LEFT JOIN inside USING (rid) LEFT JOIN listed USING (rid))
"""

SQL = (
    "WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),"
    + LEAKS_SQL
    + """
SELECT doc_id, n_words, n_hit, len(items)::BIGINT AS n_items, sha256(array_to_string(items, ',')) AS items_sha256, n_hit > 0 AS contaminated
FROM docs JOIN leaks USING (rid)"""
)
