"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts earlier, in a document of a
smaller id or before in its own.  Documents are cut at content-defined places: every such string
belongs to the smallest hash of the 20-byte strings inside it (its anchor), so equal strings
have equal anchors, and a run of strings with one anchor is a short segment of text.

1. Blocks of documents send, to buckets by anchor, one record for each distinct segment: anchor,
   digest and place, packed and compressed.  Equal segments (64-bit cryptographic digests, only
   ever compared under one anchor) are repeats as a whole but for the first.  What is left to
   compare byte by byte are the distinct segments of an anchor that has several.
2. Those segments alone go to shards by anchor.  There their suffixes are sorted by
   Larsson-Sadakane refinement; neighbours that share `length` bytes or more (Kasai) are one
   string, and all its places but the first are repeats.
3. An anchor with more than HOT_SEGMENTS of them is hot: its segments are dealt over all shards by
   their content, each shard sends its distinct strings as a sorted run of 128-bit digests to
   buckets by digest, and runs are merged by binary search, the first place of a string staying.

The texts meet the repeats found in one last join, where they are cut.  Blocks and shards are bounded
in bytes, and a task holds the strings of an anchor only if they are few.  Its records are not: one for each
place of the anchor (29 bytes before compression) meets the others in one bucket, so a footer of a third of
all documents makes a bucket of that many records.

Defined cases: null and empty texts, and shorter ones than `length`, keep all bytes; ids are
integers, null comes last; rows with equal id and text are one document and get equal results;
equal ids with different texts are ordered by a hash of the text; texts of any length are read
whole, as one block if longer than that; an empty table gives an empty result; other columns pass
through, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm import arrays as A
from docmill.llm.shared import bounded_batches, written
from docmill.llm.suffixes import common_prefixes, suffix_array

LENGTH = 100
GRAM = 20
#: Bytes of documents whose anchors one bucket takes, whose hot strings one bucket takes, of a block of documents, and of segments sorted at once.
BUCKET_BYTES, HOT_BYTES, DOC_BYTES, SHARD_BYTES = 16 << 20, 8 << 20, 4 << 20, 1 << 20
#: Distinct segments of an anchor that one block, and all blocks together, treat as usual.
HOT_IN_BLOCK, HOT_SEGMENTS = 16, 4096
LAST = (1 << 63) - 1
ID, H, TEXT = "__cut_id", "__cut_hash", "__cut_text"


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: row, first start, number of starts, anchor.

    The anchor is the leftmost of the smallest 32-bit hashes, whatever the block, so equal strings have equal ones.
    """
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none.astype(np.uint64)
    gram = min(gram, length)
    prefix = A.prefix_hash(data)
    at = np.arange(n - gram + 1)
    value = A.range_hash(prefix, at, at + gram)
    low = np.uint64(0xFFFFFFFF)
    least = (value & ~low) | at.astype(np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    place = (least & low).astype(np.int64)
    rows = len(offsets) - 1
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(rows), sizes)
    if not len(row):
        return none, none, none, none.astype(np.uint64)
    start = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[:-1], sizes)
    place = place[start]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(first)
    count = np.diff(np.append(first, len(row)))
    return row[first], start[first] - offsets[:-1][row[first]], count, value[place[first]]


RECORD, NOTICE, GONE, ASK = range(4)
#: doc points into the documents that travel with the records.
_RECORD = np.dtype([("anchor", "<u4"), ("digest", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("count", "<u4"), ("kind", "u1")])
_DOC = np.dtype([("id", "<i8"), ("hash", "<i4")])
_RANGE = np.dtype([("start", "<u4"), ("count", "<u4")])
_ASKED = np.dtype([("start", "<u4"), ("count", "<u4"), ("key", "<i8"), ("hot", "u1")])
_SENT = "bucket int, n int, records binary, n_docs int, docs binary"
_MARKS = f"{ID} long, {H} int, gone binary, asked binary"


def _squeezed(values: np.ndarray) -> bytes:
    """Records byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True)


def _opened(raw: bytes, n: int, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(kind.itemsize, n).T.copy().view(kind).ravel()


def _starts(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _records(**fields: np.ndarray) -> np.ndarray:
    kind = {1: _RANGE, 3: _ASKED}[len(fields) - 1]
    out = np.empty(len(fields["start"]), kind)
    for name, values in fields.items():
        out[name] = values
    return out


def block_records(docs: np.ndarray, data: np.ndarray, offsets: np.ndarray, buckets: int, length: int, most: int = HOT_IN_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Of a block of documents the buckets, ascending, and the records: a distinct segment once, what repeats it here as gone.

    An anchor with more than `most` distinct segments here sends a notice, and its segments as asked for already.
    """
    found, at = [], 0
    while at < len(docs):  # a part of the block at a time
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + A.BLOCK_BYTES, "right")) - 1)
        part = segments(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], length)
        found.append((part[0] + at, *part[1:]))
        at = to
    row, start, count, anchor = map(np.concatenate, zip(*found, strict=True))
    again = np.ones(len(docs), bool)  # one document in several rows is read once
    again[np.unique(docs, return_index=True)[1]] = False
    keep = ~again[row]
    row, start, count, anchor = row[keep], start[keep], count[keep], anchor[keep]
    raw, at = data.tobytes(), offsets[:-1][row] + start
    digests = [blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(at.tolist(), (at + count + length - 1).tolist(), strict=True)]
    spread = A.mix(anchor)
    out = np.empty(len(row), _RECORD)
    bucket = ((spread >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    out["anchor"], out["digest"], out["doc"], out["start"], out["count"] = spread & np.uint64(0xFFFFFFFF), np.frombuffer(b"".join(digests), "<u8"), row, start, count
    rank = np.empty(len(docs), np.int64)
    rank[np.argsort(docs, order=["id", "hash"], kind="stable")] = np.arange(len(docs))
    order = np.lexsort((start, rank[row], out["digest"], out["anchor"], bucket))
    out, bucket = out[order], bucket[order]
    if not len(out):
        return bucket, out
    of_anchor = _starts(bucket, out["anchor"])
    first = of_anchor | _starts(out["digest"])
    group = np.cumsum(of_anchor) - 1
    many = np.bincount(group[first])[group] > most
    out["kind"] = np.where(first, np.where(many, ASK, RECORD), GONE)
    notice = np.flatnonzero(of_anchor & many)
    extra = out[notice].copy()
    extra["kind"] = NOTICE
    bucket, out = np.concatenate([bucket, bucket[notice]]), np.concatenate([out, extra])
    order = np.argsort(bucket, kind="stable")
    return bucket[order], out[order]


def anchors(docs: DataFrame, buckets: int, length: int, most: int = HOT_IN_BLOCK) -> DataFrame:
    """The records of all blocks by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.empty(batch.num_rows, _DOC)
            own["id"], own["hash"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, to, data, offsets in A.blocks(batch.column(2), DOC_BYTES):
                bucket, records = block_records(own[first:to], data, offsets, buckets, length, most)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                rows = []
                for a, b in zip(cuts, np.append(cuts, len(bucket))[1:], strict=True):
                    # In the order of places, which compresses better.
                    part = records[a:b][np.lexsort((records[a:b]["start"], records[a:b]["doc"]))]
                    used, part["doc"] = np.unique(part["doc"], return_inverse=True)
                    rows.append((int(bucket[a]), len(part), _squeezed(part), len(used), _squeezed(own[first:to][used])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "n", "records", "n_docs", "docs"])

    return docs.mapInArrow(run, _SENT)


def _by_document(docs: np.ndarray, gone: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """One row for each document with its ranges; gone and asked: numbers of documents, and their ranges."""
    own, number = np.unique(docs, return_inverse=True)
    used = np.unique(np.concatenate([number[gone[0]], number[asked[0]]]))
    columns = [pa.array(own["id"][used]), pa.array(own["hash"][used])]
    for doc, values in (gone, asked):
        at = np.searchsorted(used, number[doc])
        order = np.argsort(at, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(used)))]).astype(np.int32) * values.dtype.itemsize
        columns.append(pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values[order].tobytes())]))
    return pa.RecordBatch.from_arrays(columns, names=[ID, H, "gone", "asked"])


def repeats(group: pa.Table, most: int = HOT_SEGMENTS) -> pa.Table:
    """Of a bucket, what repeats a segment (gone) and the distinct segments of anchors that have several (asked)."""
    records, docs, at = [], [], 0
    for n, raw, n_docs, raw_docs in zip(*[group.column(c).to_pylist() for c in ("n", "records", "n_docs", "docs")], strict=True):
        part = _opened(raw, n, _RECORD)
        part["doc"] += at
        records.append(part)
        docs.append(_opened(raw_docs, n_docs, _DOC))
        at += n_docs
    records, docs = np.concatenate(records), np.concatenate(docs)
    high = np.int64(group.column("bucket")[0].as_py()) << np.int64(32)
    own = records[records["kind"] == RECORD]
    place = docs[own["doc"]]
    order = np.lexsort((own["start"], place["hash"], place["id"], own["digest"], own["anchor"]))
    own, place = own[order], place[order]
    asked = hot = first = np.zeros(len(own), bool)
    if len(own):
        of_anchor = _starts(own["anchor"])
        first = of_anchor | _starts(own["digest"])
        anchor = np.cumsum(of_anchor) - 1
        distinct = np.bincount(anchor[first])[anchor]
        hot = np.isin(own["anchor"], records["anchor"][records["kind"] == NOTICE]) | (distinct > most)
        asked = first & (hot | (distinct > 1))
        leader = np.flatnonzero(first)[np.cumsum(first) - 1]
        same = (place == place[leader]) & (own["start"] == own["start"][leader])  # a document in several rows
        first = first | same
    gone = np.concatenate([own[~first], records[records["kind"] == GONE]])
    known = records[records["kind"] == ASK]
    ask = np.concatenate([own[asked], known])
    flags = np.concatenate([hot[asked], np.ones(len(known), bool)])
    return pa.Table.from_batches([_by_document(docs, (gone["doc"], _records(start=gone["start"], count=gone["count"])), (ask["doc"], _records(start=ask["start"], count=ask["count"], key=high | ask["anchor"].astype(np.int64), hot=flags)))])


def unpacked(lists: pa.Array, kind: np.dtype) -> list[np.ndarray]:
    """The records of each row of a column of lists of packed values, without a copy."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values = lists.values
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    bounds = ends[lists.offsets.to_numpy()]
    return [raw[a:b].view(kind) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def cut_out(docs: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """The segments asked for: (key, salt, segment, id, hash, start); those of a hot anchor have a salt by content, others -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, salts, parts, ids, hashes, starts, size = [], [], [], [], [], [], 0
            for doc, h, raw, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), unpacked(batch.column(3), _ASKED), strict=True):
                text = raw.as_buffer().to_pybytes()
                for s, c, k, hot in zip(*[one[f].tolist() for f in ("start", "count", "key", "hot")], strict=True):
                    part = text[s : s + c + length - 1]
                    keys.append(k)
                    salts.append(crc32(part) & 0xFFFF if hot else -1)
                    parts.append(part)
                    ids.append(doc)
                    hashes.append(h)
                    starts.append(s)
                    size += len(part)
                if size > A.BLOCK_BYTES:
                    yield found(keys, salts, parts, ids, hashes, starts)
                    keys, salts, parts, ids, hashes, starts, size = [], [], [], [], [], [], 0
            yield found(keys, salts, parts, ids, hashes, starts)

    def found(*columns: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "salt", "segment", ID, H, "start"])

    mine = docs.join(marks, [ID, H]).select(ID, H, TEXT, "marks")
    return mine.mapInArrow(run, f"key long, salt int, segment binary, {ID} long, {H} int, start long")


class Shard:
    """Segments with their keys and places (id, hash, start); equal segments under one key are one, at its first place."""

    def __init__(self, table: pa.Table) -> None:
        table = table.combine_chunks()
        self.key, self.salt = table.column("key").to_numpy(), table.column("salt").to_numpy()
        self.places = np.stack([table.column(c).to_numpy().astype(np.int64) for c in (ID, H, "start")])
        codes = table.column("segment").combine_chunks().dictionary_encode()
        code = codes.indices.to_numpy().astype(np.int64)
        by = np.lexsort((*self.places[::-1], code, self.key))
        new = _starts(self.key[by], code[by])
        first = by[np.flatnonzero(new)]
        leader = first[np.cumsum(new) - 1]
        other = (self.places[:, by] != self.places[:, leader]).any(axis=0)
        sizes = pc.binary_length(codes.dictionary).to_numpy().astype(np.int64)[code]
        #: Whole segments that repeat another one.
        self.whole = (self.places[:, by[other]], sizes[by[other]])
        self.key, self.salt, self.places = self.key[first], self.salt[first], self.places[:, first]
        values = codes.dictionary.take(pa.array(code[first])).cast(pa.large_binary())
        _, off, raw = values.buffers()
        self.bounds = np.frombuffer(off, np.int64)[values.offset : values.offset + len(values) + 1]
        self.text = np.frombuffer(raw, np.uint8)[self.bounds[0] : self.bounds[-1]]
        self.bounds = self.bounds - self.bounds[0]

    def strings(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every string of `length` bytes: its segment, its offset there and a number that equal strings share."""
        sizes = np.diff(self.bounds)
        count = sizes - length + 1
        segment = np.repeat(np.arange(len(sizes)), count)
        offset = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
        order = suffix_array(self.text, self.bounds)
        lcp = common_prefixes(self.text, self.bounds, order)
        long = self.bounds[1:][np.repeat(np.arange(len(sizes)), sizes)] - np.arange(len(self.text)) >= length
        at = np.flatnonzero(long[order])
        # What two long suffixes share is the least of what all between them share.
        between = np.minimum.reduceat(lcp[: at[-1] + 1], np.append(0, at[:-1] + 1))
        same = np.zeros(len(at), bool)
        same[1:] = between[1:] >= length
        suffix = order[at]
        string = np.searchsorted(self.bounds, suffix, "right") - 1
        number = np.empty(len(segment), np.int64)
        number[(np.cumsum(count) - count)[string] + suffix - self.bounds[string]] = np.cumsum(~same)
        return segment, offset, number

    def split(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment and offset of every string, those at their string's first place marked."""
        segment, offset, number = self.strings(length)
        ids, hashes, start = (p[segment] for p in self.places)
        by = np.lexsort((start + offset, hashes, ids, number))
        first = np.zeros(len(number), bool)
        first[by[_starts(number[by])]] = True
        return segment, offset, first


_FOUND = f"{ID} long, {H} int, gone binary, bucket int, digests binary, places binary"
_PLACE = np.dtype([("id", "<i8"), ("hash", "<i4"), ("start", "<i4")])


def _gone_rows(places: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    docs = np.empty(places.shape[1], _DOC)
    docs["id"], docs["hash"] = places[0], places[1]
    none = np.zeros(0, np.int64)
    rows = _by_document(docs, (np.arange(len(docs)), _records(start=places[2], count=count)), (none, np.zeros(0, _ASKED)))
    return rows.select([ID, H, "gone"])


def _runs(places: np.ndarray, digests: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A shard's distinct strings of hot anchors as runs sorted by digest, one a bucket."""
    bucket = (digests.view("<u8").reshape(-1, 2)[:, 0] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((digests.view("S16"), bucket))
    bucket, digests, places = bucket[order], digests[order], places[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts, len(bucket))[1:]
    n = len(cuts)
    columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(bucket[cuts], pa.int32()), pa.array([digests[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()), pa.array([places[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=[ID, H, "gone", "bucket", "digests", "places"])


def sorted_shards(cut: DataFrame, length: int, buckets: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """What repeats a string within a shard, as ranges of starts; and the runs of hot anchors."""

    def sort(table: pa.Table) -> Iterator[pa.RecordBatch]:
        shard = Shard(table)
        segment, offset, first = shard.split(length)
        again = np.flatnonzero(~first)
        # Strings that go one behind the other in a segment are one range.
        new = np.flatnonzero((np.diff(segment[again], prepend=-1) != 0) | (np.diff(offset[again], prepend=-2) != 1))
        count = np.diff(np.append(new, len(again)))
        places = shard.places[:, segment[again[new]]].copy()
        places[2] += offset[again[new]]
        gone = _gone_rows(np.concatenate([places, shard.whole[0]], axis=1), np.concatenate([count, shard.whole[1] - length + 1]))
        none = [pa.nulls(gone.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*gone.columns, *none], names=[ID, H, "gone", "bucket", "digests", "places"])
        kept = np.flatnonzero(first & (shard.salt >= 0)[segment])
        if len(kept):
            at, raw = (shard.bounds[:-1][segment[kept]] + offset[kept]).tolist(), shard.text.tobytes()
            digests = np.frombuffer(b"".join([blake2b(raw[a : a + length], digest_size=16).digest() for a in at]), "V16")
            where = np.empty(len(kept), _PLACE)
            where["id"], where["hash"], where["start"] = shard.places[0][segment[kept]], shard.places[1][segment[kept]], shard.places[2][segment[kept]] + offset[kept]
            yield from _runs(where, digests, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                parts.append(pa.Table.from_batches([batch.slice(at, 1024)]))
                size += pc.sum(pc.binary_length(parts[-1].column("segment"))).as_py() or 0
                if size < shard_bytes:
                    continue
                # Up to the last key, whose other segments may follow; a hot one may be cut anywhere.
                every = pa.concat_tables(parts)
                key = every.column("key").to_numpy()
                stop = every.num_rows if every.column("salt")[-1].as_py() >= 0 else int(np.searchsorted(key, key[-1]))
                if stop:
                    yield from sort(every.slice(0, stop))
                parts = [every.slice(stop)]
                size = pc.sum(pc.binary_length(parts[0].column("segment"))).as_py() or 0
        if size:
            yield from sort(pa.concat_tables(parts))

    return cut.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(run, _FOUND)


def merged(group: pa.Table) -> pa.Table:
    """A bucket's runs merged two by two by binary search: the places that lose."""
    runs = [(np.frombuffer(d, "S16"), np.frombuffer(p, _PLACE)) for d, p in zip(group.column("digests").to_pylist(), group.column("places").to_pylist(), strict=True)]
    lost = [np.zeros(0, _PLACE)]

    def two(a: tuple, b: tuple) -> tuple:
        (one, own), (more, other) = a, b
        at = np.searchsorted(one, more)
        hit = one[np.minimum(at, len(one) - 1)] == more
        mine, yours = own[at[hit]], other[hit]
        later = (yours["id"] > mine["id"]) | ((yours["id"] == mine["id"]) & ((yours["hash"] > mine["hash"]) | ((yours["hash"] == mine["hash"]) & (yours["start"] > mine["start"]))))
        equal = yours == mine
        lost.append(np.where(later, yours, mine)[~equal])
        own = own.copy()
        own[at[hit]] = np.where(later, mine, yours)
        return np.insert(one, at[~hit], more[~hit]), np.insert(own, at[~hit], other[~hit])

    while len(runs) > 1:
        runs = [two(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    found = np.concatenate(lost)
    return pa.Table.from_batches([_gone_rows(np.stack([found[f].astype(np.int64) for f in ("id", "hash", "start")]), np.ones(len(found), np.int64))])


def deduplicated(df: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot_in_block: int = HOT_IN_BLOCK, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """df with n_bytes, removed (the removed runs as start and end bytes) and kept (the bytes that stay)."""
    bounded_batches(df.sparkSession)
    own = df.withColumn(ID, F.coalesce(F.col(f"`{row_id}`").cast("long"), F.lit(LAST))).withColumn(TEXT, F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn(H, F.hash(TEXT))
    docs = own.where(F.octet_length(TEXT) >= length).select(ID, H, TEXT)
    total = docs.agg(F.sum(F.octet_length(TEXT))).first()[0] or 0
    sent = anchors(docs, max(8, total // BUCKET_BYTES), length, hot_in_block)
    marks, _ = written(sent.groupBy("bucket").applyInArrow(lambda group: repeats(group, hot_segments), _MARKS), "repeats")
    asked = marks.where(F.octet_length("asked") > 0).groupBy(ID, H).agg(F.collect_list("asked").alias("marks"))
    found, _ = written(sorted_shards(cut_out(docs, asked, length), length, max(8, total // HOT_BYTES), shard_bytes), "shards")
    hot = found.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(merged, f"{ID} long, {H} int, gone binary")
    every = [x.where(F.octet_length("gone") > 0).select(ID, H, "gone") for x in (marks, found, hot)]
    told = every[0].unionByName(every[1]).unionByName(every[2]).groupBy(ID, H).agg(F.collect_list("gone").alias("__cut_gone"))
    names = ["n_bytes", "removed", "kept"]
    through = [c for c in df.columns if c not in names]
    schema = T.StructType([*[df.schema[c] for c in through], *T.StructType.fromDDL("n_bytes long, removed array<struct<start: long, end: long>>, kept binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            n_bytes, removed, rest = [], [], []
            for raw, gone in zip(batch.column(at(TEXT)), unpacked(batch.column(at("__cut_gone")), _RANGE), strict=True):
                buffer = raw.as_buffer()
                data = np.frombuffer(buffer, np.uint8) if buffer.size else np.zeros(0, np.uint8)
                n_bytes.append(len(data))
                if not len(gone):
                    removed.append([])
                    rest.append(data.tobytes())
                    continue
                # A range of starts covers all bytes from the first to the end of the last string.
                flags = A.covered(gone["start"].astype(np.int64), gone["count"].astype(np.int64) + length - 1, len(data))
                edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
                removed.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                rest.append(data[~flags].tobytes())
            new = [pa.array(n_bytes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(rest, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(at(c)) for c in through], *new], names=schema.names)

    lists = F.coalesce("__cut_gone", F.array().cast("array<binary>")).alias("__cut_gone")
    return own.join(told, [ID, H], "left").select(*[F.col(f"`{c}`") for c in through], TEXT, lists).mapInArrow(run, schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda t, r: t + r["end"] - r["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
