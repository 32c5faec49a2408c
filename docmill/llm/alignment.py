"""Two tokenizers' tokens of the same texts, aligned: where both end is a cut, cuts bound groups, the tokens that end at one are a link.

Two forms give the same tables.  `relational` is DataFrame operations alone behind the encoding: tokens of both
sides are rows (posexplode), their ends windowed sums of lengths; rows of both sides meet by an
equi-join on string and end; a running count of cuts numbers the groups, and a grouped join puts a group's ids together.
Its strings are the distinct pieces of the corpus (below), which documents fetch by a join within blocks.  It moves
several times the input (README has its figures), so `align` computes groups where a text is: each worker keeps
the groups of the pieces it has met (TABLE_PIECES at most), made by the same steps in numpy: running sums of
lengths, a search of one side's ends in the other's, a running count of cuts.  Counts of id pairs, their maxima
and what documents take from them are joins and aggregates over the links in both.

Both tokenizers always cut before a space between two non-spaces (a property of their files that
is checked), so a document's alignment is that of its pieces, one behind another.  With tokenizers that cut
otherwise a whole text is a piece.

Defined cases: texts that are null or empty, or whose tokens don't give back the text with a space
before it, have no tokens: zeros and empty groups; texts of any length are whole; a null id is kept; rows of
one id, and equal rows, each give a row; ties of counts are all best; an empty table gives an empty result; extra
columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm import ids as I
from docmill.llm.shared import bounded_batches, drop, settings, written
from docmill.llm.token_files import _parts as parts_of
from docmill.llm.tokens import _WHITE

#: Bytes of texts of a block.
BLOCK_BYTES = 16 << 20
MAX_BLOCKS = 1 << 22
#: Bytes of texts taken at a time.
TEXT_BYTES = 1 << 19
#: Pieces whose groups a worker keeps.
TABLE_PIECES = 3 << 17
#: Id pairs that are sent to all tasks with their counts; with more they are joined by a shuffle.
SENT_PAIRS = 1 << 20
#: A worker that has met a longer piece starts its table anew.
LONG_PIECE = 1 << 16
#: A space beside another white space, or at an end.
_UNEVEN = re.compile(f" (?:[{_WHITE}]|$)")
#: Before a space between two characters that are no spaces, the second no white space either.
CUT = f"(?<=[^ ])(?= [^{_WHITE}])"
_CONF = {
    # Rows that lie together by one of several keys need not be moved to be joined by all of them.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Shuffle files go when the table is written.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@dataclass(frozen=True)
class Side:
    """A tokenizer: how a worker makes it, and whether it puts the space before a text itself."""

    key: tuple
    made: Callable[[], I.Library]
    adds_space: bool


def byte_level(path: str) -> Side:
    return Side((path, "plain"), lambda: I.TokenizersFile(path, plain=True), False)


def sentence_piece(path: str) -> Side:
    return Side((path,), lambda: I.SentencePieceFile(path), True)


class Coder:
    """Ids and lengths of strings that begin with a space, by a side."""

    def __init__(self, side: Side, cached: int = I.CACHE_PIECES) -> None:
        library = side.made()
        self.adds_space, self.library = side.adds_space, library
        self.cache = I.Cache(library, size=cached)
        self.bytes = library.token_bytes()
        self.size = np.array([len(b) for b in self.bytes], np.int32)

    def flat(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bool]]:
        """Ids of all strings in a row, bounds of each, lengths of the ids, and which strings the ids give back."""
        if self.adds_space:
            got = self.library.encode([s[1:] for s in strings])
            bounds = np.cumsum([0, *map(len, got)])
            flat = np.fromiter(chain.from_iterable(got), np.int32, int(bounds[-1]))
        else:
            flat, bounds = self.cache.ids(strings)
        parts, edges = list(map(self.bytes.__getitem__, flat.tolist())), bounds.tolist()
        same = [b"".join(parts[a:b]) == s.encode() for s, a, b in zip(strings, edges[:-1], edges[1:], strict=True)]
        return flat, bounds, self.size[flat].astype(np.int64), same

    def of(self, strings: list[str]) -> tuple[pa.Array, pa.Array, list[bool]]:
        flat, bounds, size, same = self.flat(strings)
        offsets = pa.array(bounds.astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(size.astype(np.int32))), same


class Pieces:
    """A worker's groups of pieces: slot of each piece, and by slot its numbers of tokens, its groups as text and its links in one flat array."""

    def __init__(self, a: Side, b: Side, cut: str | None, size: int = TABLE_PIECES) -> None:
        self.coders, self.size = [Coder(a, 0), Coder(b, 0)], size
        self.cut = re.compile(cut) if cut else None
        n = max(len(c.bytes) for c in self.coders)
        #: Text of an id and what stands behind it: , within a side, | and ; where a side's part of a group ends.
        self.said = [f"{i}{mark}" for i in range(n) for mark in ",|;"]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.zeros((4, 1 << 12), np.int64)  # tokens of a, of b, links, hits
        self.same = np.zeros(1 << 12, bool)
        self.starts = np.zeros(1 << 12, np.int64)
        self.links = np.zeros((2, 1 << 14), np.int32)
        self.used = 0

    def _thin(self) -> None:
        """Leaves the pieces met most often, a third of `size` at most and none met once."""
        have = len(self.groups)
        hits = self.numbers[3, :have]
        floor = max(2, int(np.partition(hits, -(self.size // 3))[-(self.size // 3)]) + 1) if have > self.size // 3 else 2
        kept = [(p, i) for p, i in self.index.items() if hits[i] >= floor]
        at = np.array([i for _, i in kept], np.int64)
        old = self.groups, self.numbers[:, at], self.same[at], self.links[:, I.ranges(self.starts[at], self.numbers[2, at])]
        self.clear()
        self._keep([p for p, _ in kept], [old[0][i] for i in at.tolist()], old[1], old[2], old[3])

    def _keep(self, pieces: Sequence[str], groups: list[str], numbers: np.ndarray, same: np.ndarray, links: np.ndarray) -> None:
        have, n, more = len(self.groups), len(pieces), links.shape[1]
        while have + n > len(self.starts):
            self.numbers, self.same, self.starts = np.concatenate([self.numbers, np.zeros_like(self.numbers)], axis=1), np.append(self.same, np.zeros_like(self.same)), np.append(self.starts, np.zeros_like(self.starts))
        while self.used + more > self.links.shape[1]:
            self.links = np.concatenate([self.links, np.zeros_like(self.links)], axis=1)
        to = slice(have, have + n)
        self.numbers[:, to], self.same[to], self.starts[to] = numbers, same, self.used + np.cumsum(numbers[2]) - numbers[2]
        self.links[:, self.used : self.used + more] = links
        self.used += more
        self.index.update(zip(pieces, range(have, have + n), strict=True))
        self.groups += groups

    def _made(self, pieces: list[str]) -> None:
        ids, bounds, sizes, good = zip(*(c.flat(pieces) for c in self.coders), strict=True)
        same = np.array(good[0]) & np.array(good[1])
        room = np.array([len(p.encode()) for p in pieces], np.int64)
        base = np.cumsum(room) - room
        # Pieces that aren't given back have no tokens.
        of, ends, tokens = [], [], []
        for x, edge, size in zip(ids, bounds, sizes, strict=True):
            piece = np.repeat(np.arange(len(pieces)), np.diff(edge))
            total = np.cumsum(size)
            end = total - np.append(0, total)[edge[piece]] + base[piece]
            keep = same[piece]
            of.append(piece[keep])
            ends.append(end[keep])
            tokens.append(x[keep])
        cut = [_inside(ends[0], ends[1]), _inside(ends[1], ends[0])]
        group = [np.cumsum(c) - c for c in cut]
        count = [np.bincount(p, minlength=len(pieces)) for p in of]
        first = [np.append(0, np.cumsum(np.bincount(g, minlength=int(cut[0].sum())))) for g in group]
        # In the order of groups, those of a before those of b.
        said = np.empty(len(tokens[0]) + len(tokens[1]), np.int64)
        said[np.arange(len(tokens[0])) + first[1][group[0]]] = 3 * tokens[0].astype(np.int64) + cut[0]
        said[np.arange(len(tokens[1])) + first[0][group[1] + 1]] = 3 * tokens[1].astype(np.int64) + 2 * cut[1]
        texts = list(map(self.said.__getitem__, said.tolist()))
        edges = np.append(0, np.cumsum(count[0] + count[1])).tolist()
        groups = ["".join(texts[x:y])[:-1] for x, y in zip(edges[:-1], edges[1:], strict=True)]
        links = np.stack([tokens[0][cut[0]], tokens[1][cut[1]]]).astype(np.int32)
        n_links = np.bincount(of[0][cut[0]], minlength=len(pieces))
        self._keep(pieces, groups, np.stack([count[0], count[1], n_links, np.zeros_like(n_links)]), same, links)

    def of(self, texts: Sequence[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Tokens of a, of b and links of each text (zeros if it has none or isn't given back), groups, links and their bounds."""
        rows = [self._cut(" " + t) if t else [] for t in texts]
        fresh = set().union(*rows).difference(self.index)
        if len(self.index) + len(fresh) > self.size and self.index:
            self._thin()
            fresh = set().union(*rows).difference(self.index)
        if fresh:
            self._made(list(fresh))
        n = np.array([len(r) for r in rows], np.int64)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(rows)), np.int64, int(n.sum()))
        self.numbers[3, : len(self.groups)] += np.bincount(at, minlength=len(self.groups))
        edges = np.append(0, np.cumsum(n))
        total = lambda x: np.diff(np.append(0, np.cumsum(x))[edges])
        good = total(~self.same[at]) == 0
        groups = [";".join(map(self.groups.__getitem__, at[x:y].tolist())) if g else "" for x, y, g in zip(edges[:-1].tolist(), edges[1:].tolist(), good.tolist(), strict=True)]
        numbers = np.stack([np.where(good, total(self.numbers[k][at]), 0) for k in range(3)])
        at = at[np.repeat(good, n)]
        links = self.links[:, I.ranges(self.starts[at], self.numbers[2, at])]
        if self.index and max(map(len, fresh), default=0) > LONG_PIECE:  # used once: not kept for their length
            self.clear()
        return numbers, groups, links, np.append(0, np.cumsum(numbers[2]))

    def _cut(self, text: str) -> list[str]:
        if self.cut is None:
            return [text]
        if _UNEVEN.search(text):
            return self.cut.split(text)
        return [" " + w for w in text[1:].split(" ")]


def _inside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the ascending x are among the ascending y."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def coded(pieces: DataFrame, a: Side, b: Side) -> DataFrame:
    """pieces (piece, n) with a number k, ids and lengths of both sides, and whether the tokens of both are the piece."""
    bounded_batches(pieces.sparkSession)
    kind = "piece string, n long, k long, a array<int>, a_size array<int>, b array<int>, b_size array<int>, same boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [I.worker(("align", *side.key), lambda side=side: Coder(side)) for side in (a, b)]
        for batch in batches:
            strings = batch.column(0).to_pylist()
            (x, x_size, good), (y, y_size, fine) = (c.of(strings) for c in coders)
            yield pa.RecordBatch.from_arrays([*batch.columns, x, x_size, y, y_size, pa.array([p and q for p, q in zip(good, fine, strict=True)])], names=["piece", "n", "k", "a", "a_size", "b", "b_size", "same"])

    return pieces.select("piece", "n", F.monotonically_increasing_id().alias("k")).mapInArrow(run, kind)


def _tokens(strings: DataFrame, side: str) -> DataFrame:
    """k, end and id of a side's tokens, a row each."""
    rows = strings.select("k", F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_size").alias("size"))).alias("pos", "t"))
    end = F.sum("t.size").over(Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("k", end.alias("end"), F.col("t.id").alias(side))


def grouped(strings: DataFrame) -> DataFrame:
    """Groups of strings (k, a, a_size, b, b_size): k, groups (`a1,a2|b1;...`), link_a and link_b (ids that end together, in order)."""
    dealt = strings.select("k", "a", "a_size", "b", "b_size").repartition("k")
    both = _tokens(dealt, "a").join(_tokens(dealt, "b"), ["k", "end"], "full")
    cut = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)
    before = F.count(cut).over(Window.partitionBy("k").orderBy("end").rowsBetween(Window.unboundedPreceding, -1))
    rows = both.select("k", "end", "a", "b", before.alias("g"))
    # Each side's ids of a group, by their ends; the last of both end together.
    of = lambda side: F.sort_array(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", side))))[side]
    groups = rows.groupBy("k", "g").agg(of("a").alias("a"), of("b").alias("b"))
    text = F.concat(F.array_join(F.col("a").cast("array<string>"), ","), F.lit("|"), F.array_join(F.col("b").cast("array<string>"), ","))
    groups = groups.select("k", F.struct("g", text.alias("text"), F.try_element_at("a", F.lit(-1)).alias("a"), F.try_element_at("b", F.lit(-1)).alias("b")).alias("group"))
    whole = groups.groupBy("k").agg(F.sort_array(F.collect_list("group")).alias("all"))
    return whole.select("k", F.array_join("all.text", ";").alias("groups"), F.col("all.a").alias("link_a"), F.col("all.b").alias("link_b"))


def pair_counts(pieces: DataFrame) -> DataFrame:
    """a, b, count and best (no other pair of b has more) of the links of pieces (n, link_a, link_b)."""
    links = pieces.select("n", F.explode(F.arrays_zip("link_a", "link_b")).alias("l")).select("n", F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b"))
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


@dataclass(frozen=True)
class Alignment:
    """documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.  pairs: a, b, count, best."""

    documents: DataFrame
    pairs: DataFrame


def _scored(pieces: DataFrame, pairs: DataFrame) -> DataFrame:
    """piece, groups, numbers of tokens and links, and sums over links, as one struct."""
    n_pairs = pairs.count()
    known = F.broadcast(pairs) if n_pairs <= SENT_PAIRS else pairs
    links = pieces.select("k", F.explode(F.arrays_zip("link_a", "link_b")).alias("l")).select("k", F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b"))
    sums = links.join(known, ["a", "b"]).groupBy("k").agg(F.count(F.when(F.col("best"), 1)).alias("n_best"), F.sum("count").alias("count_sum"))
    numbers = F.struct("groups", "n_a", "n_b", F.size("link_a").alias("n_links"), "n_best", "count_sum")
    return pieces.join(sums, "k").select("piece", numbers.alias("p"))


def lost(a: Side, b: Side) -> set[str] | None:
    """Characters that one of the sides doesn't give back; None where texts can't be cut for both."""
    out: set[str] = set()
    for side in (a, b):
        library = side.made()
        own = library.altered() if isinstance(library, I.SentencePieceFile) else set() if library.cuts else None
        if own is None:
            return None
        out |= own
    return out


def align(df: DataFrame, a: Side, b: Side, row_id: str = "doc_id", text: str = "text", groups: Callable[[Column], Column] = lambda g: g) -> Alignment:
    """Both sides' tokens of a space and the text.  groups: what is kept of a document's groups, which are longer than the text.

    Links and counts are tables in the shared folder.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(f"`{row_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    cut = CUT if lost(a, b) is not None else None
    kind = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_links")], T.StructField("groups", T.StringType()), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("link_a", "link_b")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = I.worker(("pieces", *a.key, *b.key, cut), lambda: Pieces(a, b, cut))
        for batch in batches:
            row = 0
            for part in parts_of(batch.column(1), TEXT_BYTES):
                numbers, texts, links, bounds = pieces.of(part.to_pylist())
                offsets = pa.array(bounds.astype(np.int32))
                columns = [batch.column(0).slice(row, len(part)), *[pa.array(x) for x in numbers], pa.array(texts, pa.string()), *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in links]]
                yield pa.RecordBatch.from_arrays(columns, names=kind.names)
                row += len(part)

    found, _ = written(docs.mapInArrow(run, kind).withColumn("groups", groups(F.col("groups"))), "align-links")
    linked = found.select(F.lit(1).cast("long").alias("n"), "link_a", "link_b")
    pairs, _ = written(pair_counts(linked), "align-pairs")
    known = F.broadcast(pairs) if pairs.count() <= SENT_PAIRS else pairs
    rows = found.withColumn("row", F.monotonically_increasing_id())
    # What a row's links take from the counts is summed where the row is; a row has one partial sum a task.
    each = rows.select("row", F.explode(F.arrays_zip("link_a", "link_b")).alias("l")).select("row", F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b"))
    sums = each.join(known, ["a", "b"]).groupBy("row").agg(F.count(F.when(F.col("best"), 1)).alias("n_best"), F.sum("count").alias("count_sum"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", number("n_best"), number("count_sum"), "groups")
    return Alignment(out, pairs)


def relational(df: DataFrame, a: Side, b: Side, row_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Alignment:
    """Both sides' tokens of a space and the text.  Results are tables in the shared folder."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{row_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = min(MAX_BLOCKS, max(1, -(-total // block_bytes)))
    altered = lost(a, b)
    whole = F.when(F.col("text") != "", F.concat(F.lit(" "), "text"))
    if altered:
        whole = F.when(~F.col("text").rlike("[" + "".join(map(re.escape, sorted(altered))) + "]"), whole)
    words: Column = F.split("whole", CUT) if altered is not None else F.when(F.col("whole").isNotNull(), F.array("whole"))
    # By content, so that a block's documents are the same whenever it is read.
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")
    dealt = docs.select("doc_id", whole.alias("whole"), block.alias("block")).repartitionById(n_blocks, "block")
    temporary = []

    def table(rows: DataFrame, what: str) -> DataFrame:
        with settings(spark, _CONF):
            out, path = written(rows, f"align-{what}")
        temporary.append(path)
        return out

    # The distinct pieces of each block, then of all blocks.
    own = table(dealt.select("block", F.explode(words).alias("piece")).groupBy("block", "piece").agg(F.count("*").alias("n")), "blocks")
    strings = table(coded(own.groupBy("piece").agg(F.sum("n").alias("n")), a, b), "coded")
    sizes = strings.select("k", "piece", "n", "same", F.size("a").alias("n_a"), F.size("b").alias("n_b"))
    pieces = table(sizes.where("same").join(grouped(strings.where("same")), "k"), "pieces")
    if altered is not None and not strings.where("NOT same").isEmpty():
        raise ValueError("a tokenizer gives back some piece otherwise than its characters show")
    pairs, _ = written(pair_counts(pieces), "align-pairs")
    # Each block gets what its pieces need; its documents' words are already there.
    fetched = own.select("block", "piece").join(_scored(pieces, pairs), "piece").select(F.xxhash64("piece").alias("h"), "block", "piece", "p").repartitionById(n_blocks, "block")
    said = dealt.withColumn("row", F.monotonically_increasing_id()).select("row", "block", "doc_id", F.posexplode_outer(words).alias("pos", "piece"))
    met = said.select(F.xxhash64("piece").alias("h"), "*").join(fetched, ["h", "block", "piece"], "left")
    total_of = lambda c: F.coalesce(F.sum(f"p.{c}"), F.lit(0)).cast("long").alias(c)
    groups = F.array_join(F.sort_array(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("pos", "p.groups")))).groups, ";").alias("groups")
    sums = met.groupBy("row", "block", "doc_id").agg(*[total_of(c) for c in ("n_a", "n_b", "n_links", "n_best", "count_sum")], groups)
    out = sums.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups")
    with settings(spark, _CONF):
        documents, _ = written(out, "align-documents")
    for path in temporary:
        drop(spark, path)
    return Alignment(documents, pairs)


def op11_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sides = byte_level(public_tokenizers.path("byte_bpe_50k.json")), sentence_piece(public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda g: F.when(g != "", F.sha2(g, 256)).otherwise("")
    return align(docs, *sides, groups=digest).documents.withColumnRenamed("groups", "groups_sha256")
