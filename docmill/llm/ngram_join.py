"""N-gram Jaccard join: documents whose shingle sets have a similarity of 0.8 or more.

Texts become sets of hashed word shingles.  Documents with equal sets form a class, and only
classes are joined.  Shingles have one global order, rare ones first, by a sketch of their counts over
all documents: one counter for each CELL_SHINGLES shingles of the input, at most 2^MOST_BITS, kept as
logarithms in a byte each where they are broadcast.  Two sets can only be similar if they share a
shingle among the first n - ceil(0.8 n) + 1 of each; classes therefore
meet in the posting lists of such prefix shingles, where the length and the positional filter drop
most pairs.  What is left is verified once per pair, behind a suffix filter, with both whole sets.

Groups of thousands of near copies would make all their pairs.  Each posting list first pairs
only its hub, the member with the fewest rarer shingles, with the others; verified links give
components; then the lists with members of different components are read again and pair only those.
No link between components is lost, and pairs inside one can't change the result.

Hot shingles are known from the sketch beforehand.  Their postings are dealt out over a grid of cells, each pair of
parts meeting in one, so no list outgrows 2 * LIST_PART members; what is read again is dealt likewise
in parts of CELL_PART.  The pairs of a hub are dealt by HUB_PAIRS, its text going to each portion once.

Defined cases: null texts, and texts without a word, have the empty set and link with nothing,
not even each other; fewer words than a shingle make one shingle; repeated rows and equal ids
fall in one class if their sets are equal; a null id never names a component unless all of it
is null; an empty table gives an empty result; other columns are left out of the result, so
extra columns can't clash; texts of any length are read whole; of members equally far back in a list the
one with the smaller key is the hub, which changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docmill.llm import arrays as A
from docmill.llm.components import components
from docmill.llm.shared import bounded_batches, drop, written

WORDS = 5
#: The similarity as a fraction.
NUM, DEN = 4, 5
#: Counters of the sketch: how many shingles share one, least and most bits; slices in which they are added up, and shingles counted at once.
CELL_SHINGLES, LEAST_BITS, MOST_BITS, SLICES, COUNTED = 64, 16, 24, 64, 4_000_000
#: Bytes of text for one shingle, about.
SHINGLE_BYTES = 6
LIST_PART, CELL_PART, HUB_PAIRS = 50_000, 512, 1024
#: Postings a group of buckets aims at.
BUCKET_POSTINGS = 500_000
_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every text, ascending, and their row bounds."""
    words = A.Words(data, offsets, A.SPACED, lower=True)
    at = A.full_windows(words, size)
    hashes, row = A.window_hash(words.hashes, size)[at], words.row[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    for n in np.unique(words.counts[short]):
        rows = short[words.counts[short] == n]
        hashes = np.concatenate([hashes, A.window_hash(words.hashes, n)[words.first[rows]] if n > 1 else A.mix(words.hashes[words.first[rows]])])
        row = np.concatenate([row, rows])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(words.rows + 1))


def class_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A key of 16 bytes for each set, from its size and two sums; b"" for the empty set."""
    n = np.diff(bounds)
    one = np.concatenate([[np.uint64(0)], np.cumsum(A.mix(hashes), dtype=np.uint64)])
    two = np.concatenate([[np.uint64(0)], np.cumsum(A.mix(hashes ^ _SALT), dtype=np.uint64)])
    pair = np.stack([A.mix(one[bounds[1:]] - one[bounds[:-1]] + n.astype(np.uint64)), A.mix(two[bounds[1:]] - two[bounds[:-1]])], axis=1)
    return np.array([b if k else b"" for b, k in zip(map(bytes, np.ascontiguousarray(pair)), n, strict=True)], object)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-n * NUM // DEN) + 1


def least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The smallest intersection of sets of n and m with similarity NUM / DEN."""
    return -(-NUM * (n + m) // (NUM + DEN))


def with_keys(df: DataFrame, text: str, n_name: str, key_name: str) -> DataFrame:
    """df with the size and the class of the set of its text, under the given names."""
    kept = [c for c in df.columns if c not in (n_name, key_name)]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(n_name, T.LongType()), T.StructField(key_name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            n, keys = [np.zeros(0, np.int64)], [np.zeros(0, object)]
            for _, _, data, offsets in A.blocks(batch.column(at(text))):
                hashes, bounds = shingle_sets(data, offsets)
                n.append(np.diff(bounds))
                keys.append(class_keys(hashes, bounds))
            yield pa.RecordBatch.from_arrays([*[batch.column(at(c)) for c in kept], pa.array(np.concatenate(n)), pa.array(np.concatenate(keys), pa.binary())], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def sketch_bits(text_bytes: int) -> int:
    """Bits of a sketch for so many bytes of text."""
    return min(MOST_BITS, max(LEAST_BITS, int(text_bytes / SHINGLE_BYTES / CELL_SHINGLES).bit_length()))


def keyed(docs: DataFrame, bits: int, counted: int = COUNTED) -> DataFrame:
    """docs (id, text) as (id, n, key): the size and class of each set; and, with a null key, every task's counters of how many
    sets hold a shingle, summed by `bits` of its hash, as SLICES compressed slices (slice, counts)."""
    width = (1 << bits) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, parts, held = np.zeros(1 << bits, np.int32), [], 0

        def add() -> None:
            if parts:
                total[:] += np.bincount((np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)
                parts.clear()

        for batch in batches:
            n, keys = [np.zeros(0, np.int64)], [np.zeros(0, object)]
            for _, _, data, offsets in A.blocks(batch.column(1)):
                hashes, bounds = shingle_sets(data, offsets)
                n.append(np.diff(bounds))
                keys.append(class_keys(hashes, bounds))
                parts.append(hashes)
                held += len(hashes)
                if held >= counted:
                    add()
                    held = 0
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), pa.array(np.concatenate(keys), pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=schema.names)
        add()
        filled = [k for k in range(SLICES) if total[k * width : (k + 1) * width].any()]
        # Byte plane by byte plane, which compresses well: most counters are small.
        planes = [pa.compress(np.ascontiguousarray(total[k * width : (k + 1) * width].view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True) for k in filled]
        rows = len(filled)
        yield pa.RecordBatch.from_arrays([pa.nulls(rows, id_type), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary()), pa.array(filled, pa.int32()), pa.array(planes, pa.binary())], names=schema.names)

    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *T.StructType.fromDDL("n long, key binary, slice int, counts binary").fields])
    id_type = to_arrow_type(docs.schema["id"].dataType)
    return docs.select("id", "text").mapInArrow(run, schema)


#: The largest count that a byte of the sketch stands for: eight steps double it.
_COUNT_OF = np.ceil(2.0 ** (np.arange(256) / 8)).astype(np.int64) - 1


def sketch(found: DataFrame, bits: int) -> np.ndarray:
    """The counters of what keyed gives, added up slice by slice, as places in _COUNT_OF: one byte for each of 2^bits."""
    width = (1 << bits) // SLICES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                planes = np.frombuffer(pa.decompress(raw.as_buffer(), 4 * width, codec="zstd", asbytes=True), np.uint8)
                total[k] = total.get(k, 0) + planes.reshape(4, width).T.copy().view(np.int32).ravel().astype(np.int64)
        codes = [np.minimum(np.searchsorted(_COUNT_OF, t), 255).astype(np.uint8).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(codes, pa.binary())], names=["slice", "codes"])

    rows = found.where("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(add, "slice int, codes binary").collect()
    out = np.zeros((SLICES, width), np.uint8)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["codes"], np.uint8)
    return out.ravel()


def postings(docs: DataFrame, counts, buckets: int, list_part: int = LIST_PART) -> DataFrame:
    """The prefix shingles of every class, once a task: rows (bucket, keys, n, token, at, pos), `at` pointing into keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        shift = np.uint64(64 - len(table).bit_length() + 1)
        usual = int(np.median(_COUNT_OF[table]))
        seen: set[bytes] = set()
        for batch in batches:
            for _, _, data, offsets in A.blocks(batch.column(0)):
                hashes, bounds = shingle_sets(data, offsets)
                keys = class_keys(hashes, bounds)
                if len(seen) > 1_000_000:
                    seen.clear()
                fresh = np.array([bool(k) and k not in seen and not seen.add(k) for k in keys], bool)
                row = np.repeat(np.arange(len(keys)), np.diff(bounds))
                hashes, row = hashes[fresh[row]], row[fresh[row]]
                count = table[(hashes >> shift).astype(np.int64)]
                order = np.lexsort((hashes, count, row))
                hashes, row, count = hashes[order], row[order], count[order]
                n = np.where(fresh, np.diff(bounds), 0)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                keep = pos < prefix_length(n)[row]
                token, row, pos, count = hashes[keep], row[keep], pos[keep], count[keep]
                # Hot shingles: part s of parts goes to the cells (s, t) and (t, s) of a grid, named by a hash.
                parts = np.maximum(1, -(-(_COUNT_OF[count] - usual) // list_part))
                many = np.flatnonzero(parts > 1)
                if len(many):
                    own = (A.mix(np.array([int.from_bytes(keys[r][:8], "little") for r in row[many]], np.uint64)) % parts[many].astype(np.uint64)).astype(np.int64)
                    times = parts[many]
                    other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    low, high = np.minimum(np.repeat(own, times), other), np.maximum(np.repeat(own, times), other)
                    cell = A.mix(np.repeat(token[many], times) + A.mix((low * (1 << 20) + high + 1).astype(np.uint64)))
                    cold = parts == 1
                    token, row, pos = np.concatenate([token[cold], cell]), np.concatenate([row[cold], np.repeat(row[many], times)]), np.concatenate([pos[cold], np.repeat(pos[many], times)])
                bucket = (A.mix(token) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, token, row, pos = bucket[order], token[order], row[order], pos[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                rows = []
                for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                    own, at = np.unique(row[a:b], return_inverse=True)
                    rows.append((int(bucket[a]), b"".join(keys[own]), n[own].astype(np.int32), token[a:b].view(np.int64), at.astype(np.int32), pos[a:b].astype(np.int32)))
                if rows:
                    kinds = [pa.int32(), pa.binary(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array([x if not isinstance(x, np.ndarray) else x.tobytes() for x in column], kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "keys", "n", "token", "at", "pos"])

    return docs.select("text").mapInArrow(run, "bucket int, keys binary, n binary, token binary, at binary, pos binary")


def allowed(n, pos, m, other) -> np.ndarray:
    """Length and positional filter: can sets of n and m that share the shingle at these places be similar?"""
    fits = (np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM)
    return fits & (1 + np.minimum(n - pos - 1, m - other - 1) >= least_overlap(n, m))


_LISTS = "a binary, b binary, list long, keys binary, n binary, pos binary"


def meet(group: pa.Table) -> pa.Table:
    """A bucket's posting lists: pairs (a, b) of each hub with its list, and the lists of three and more."""
    keys, n, token, at, pos, base = [], [], [], [], [], 0
    for i in range(group.num_rows):
        raw = {c: group.column(c)[i].as_py() for c in ("keys", "n", "token", "at", "pos")}
        own = np.frombuffer(raw["keys"], "V16")
        keys.append(own)
        n.append(np.frombuffer(raw["n"], np.int32))
        token.append(np.frombuffer(raw["token"], np.uint64))
        at.append(np.frombuffer(raw["at"], np.int32) + base)
        pos.append(np.frombuffer(raw["pos"], np.int32))
        base += len(own)
    keys, n, token, at, pos = map(np.concatenate, (keys, n, token, at, pos))
    keys, first, back = np.unique(keys.view([("x", "u8"), ("y", "u8")]), return_index=True, return_inverse=True)
    n, at = n[first], back[at]
    order = np.lexsort((at, pos, token))
    token, at, pos = token[order], at[order], pos[order]
    # One class comes once a task: keep it once a list.
    by = np.lexsort((at, token))
    again = np.zeros(len(at), bool)
    again[by[1:]] = (token[by[1:]] == token[by[:-1]]) & (at[by[1:]] == at[by[:-1]])
    token, at, pos = token[~again], at[~again], pos[~again]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(start, len(token)))
    hub = np.repeat(start, size)
    me = np.arange(len(token))
    ok = (hub != me) & allowed(n[at], pos, n[at[hub]], pos[hub])
    pairs = np.unique(np.stack([at[hub[ok]], at[ok]]), axis=1)
    raw = [k.tobytes() for k in keys]
    a, b = [raw[i] for i in pairs[0]], [raw[i] for i in pairs[1]]
    rows = [(None, None, int(token[s].view(np.int64)), keys[at[s : s + k]].tobytes(), n[at[s : s + k]].tobytes(), pos[s : s + k].tobytes()) for s, k in zip(start, size, strict=True) if k > 2]
    columns = [*zip(*rows, strict=True)] or [()] * 6
    lists = pa.table({c: pa.array(list(v), t) for c, v, t in zip(("a", "b", "list", "keys", "n", "pos"), columns, (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)})
    none = pa.nulls(len(a))
    found = pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "list": none.cast(pa.int64()), "keys": none.cast(pa.binary()), "n": none.cast(pa.binary()), "pos": none.cast(pa.binary())})
    return pa.concat_tables([found, lists])


def across(group: pa.Table) -> pa.Table:
    """A cell of a list, one part or two: pairs of different labels that pass the filters, of two parts only those between them."""
    label = group.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    n, pos, part = (group.column(c).to_numpy() for c in ("n", "pos", "part"))
    key = group.column("key").combine_chunks()
    left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
    meets = (label[left][:, None] != label[right]) & allowed(n[left][:, None], pos[left][:, None], n[right], pos[right])
    x, y = np.nonzero(meets)
    x, y = left[x], right[y]
    if part.min() == part.max():
        x, y = x[x < y], y[x < y]
    return pa.table({"a": key.take(pa.array(x)), "b": key.take(pa.array(y))})


def suffix_filter(x: np.ndarray, y: np.ndarray, need: int, depth: int = 3) -> bool:
    """Whether sorted x and y can share `need` elements: cut both at x's middle again and again and add up the smaller sides."""
    def bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
        if not depth or len(x) < 2 or len(y) < 2:
            return min(len(x), len(y))
        middle = len(x) // 2
        cut = int(np.searchsorted(y, x[middle]))
        return bound(x[:middle], y[:cut], depth - 1) + bound(x[middle:], y[cut:], depth - 1)

    return bound(x, y, depth) >= need


def verified(pairs: DataFrame, sets: DataFrame, most: int = HUB_PAIRS) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar; sets: (key, text).

    The text of b comes to its a, whose own text comes once for every `most` pairs.
    """
    hubs = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / most).cast("int").alias("portions"))
    dealt = pairs.join(hubs, "a").select("a", "b", F.pmod(F.hash("b"), "portions").alias("portion"))
    members = dealt.join(sets, dealt["b"] == sets["key"]).select("a", "portion", "b", "text")
    heads = hubs.join(sets, hubs["a"] == sets["key"]).select("a", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(None).cast("binary").alias("b"), "text")
    rows = heads.unionByName(members).repartition("a", "portion").sortWithinPartitions("a", "portion", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep, at = [], 0
            names, others = batch.column(0).to_pylist(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for _, _, data, offsets in A.blocks(batch.column(2)):
                hashes, bounds = shingle_sets(data, offsets)
                for i in range(len(bounds) - 1):
                    x = hashes[bounds[i] : bounds[i + 1]]
                    if others[at]:
                        head, own = names[at], x
                    elif names[at] == head:
                        need = int(least_overlap(len(own), len(x)))
                        if suffix_filter(own, x, need) and len(np.intersect1d(own, x, assume_unique=True)) >= need:
                            keep.append(at)
                    else:
                        raise AssertionError("a pair without its first text")
                    at += 1
            mask = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(mask), batch.column(1).take(mask)], names=["a", "b"])

    return rows.select("a", "b", "text").mapInArrow(run, "a binary, b binary")


def class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text): one text for each wanted class (key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys = np.concatenate([class_keys(*shingle_sets(d, o)) for _, _, d, o in A.blocks(batch.column(0))] or [np.zeros(0, object)])
            if len(seen) > 1_000_000:
                seen.clear()
            fresh = np.flatnonzero([bool(k) and k not in seen and not seen.add(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(keys[fresh], pa.binary()), batch.column(0).take(pa.array(fresh))], names=["key", "text"])

    texts = docs.select("text").mapInArrow(run, "key binary, text string")
    return texts.join(wanted, "key", "left_semi").groupBy("key").agg(F.any_value("text").alias("text"))


def links(docs: DataFrame, list_part: int = LIST_PART, cell_part: int = CELL_PART, bucket_postings: int = BUCKET_POSTINGS, hub_pairs: int = HUB_PAIRS) -> tuple[DataFrame, DataFrame]:
    """docs (id, text): (id, n, key) of every row, and (node, label) of the classes that link with others."""
    spark = docs.sparkSession
    bounded_batches(spark)
    bits = sketch_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    found, _ = written(keyed(docs, bits), "classes")
    counts = spark.sparkContext.broadcast(sketch(found, bits))
    rows = found.where("slice IS NULL").select("id", "n", "key")
    total = rows.groupBy("key").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] or 0
    buckets = max(8, total * (DEN - NUM) // DEN // bucket_postings)
    met, lists = written(postings(docs, counts, buckets, list_part).groupBy("bucket").applyInArrow(meet, _LISTS), "lists")
    # A pair once, whichever of the two is the hub.
    once = met.where("a IS NOT NULL").groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min("a").alias("a"))
    pairs = once.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))
    opened = opened_lists(met.where("list IS NOT NULL").select("list", "keys", "n", "pos"), cell_part)
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(opened.select("key")).distinct()
    texts, kept = written(class_texts(docs, wanted), "texts")
    first, one = written(verified(pairs, texts, hub_pairs), "links")
    labels, _ = written(components(first.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")
    labelled = opened.join(labels, opened["key"] == labels["node"], "left").select("list", "key", "n", "pos", "part", "parts", F.coalesce("label", "key").alias("label"))
    mixed = labelled.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("list")
    cells = labelled.join(mixed, "list", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = cells.select("list", "key", "n", "pos", "part", "label", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    # Dealt anew, over all tasks: by the list alone, as the join leaves them, all cells of a list would stay in one.
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "list", "low", "high")
    more = dealt.groupBy("list", "low", "high").applyInArrow(across, "a binary, b binary")
    more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # Written first, as verified reads its pairs twice.
    fresh, new = written(more.join(tried, ["a", "b"], "left_anti"), "pairs")
    second, two = written(verified(fresh, texts, hub_pairs), "links")
    if not second.isEmpty():
        joined = labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(second.select(F.col("a").alias("u"), F.col("b").alias("v")))
        labels, _ = written(components(joined), "labels")
    for path in (lists, kept, one, new, two):  # nothing reads them any more
        drop(spark, path)
    return rows, labels


def opened_lists(lists: DataFrame, part: int) -> DataFrame:
    """A row for each member of a list, with the number of its part and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = np.frombuffer(batch.column(1)[i].as_py(), "V16")
                n, pos = (np.frombuffer(batch.column(k)[i].as_py(), np.int32) for k in (2, 3))
                size = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * size, pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(n), pa.array(pos), pa.array(np.arange(size) // part, pa.int32()), pa.array([-(-size // part)] * size, pa.int32())],
                    names=["list", "key", "n", "pos", "part", "parts"],
                )

    return lists.mapInArrow(run, "list long, key binary, n int, pos int, part int, parts int")


def near_duplicates(df: DataFrame, row_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """One row for each row of df: the id, n_shingles and component_id, the smallest id that links reach."""
    docs = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows, labels = links(docs, **limits)
    named = rows.join(labels, rows["key"] == labels["node"], "left").select("id", "n", F.coalesce("label", "key").alias("component"))
    # The empty set links with nothing: its rows keep their own ids and leave the join below.
    empty = named.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    full = named.where("n > 0")
    # Written first: a join of two plain shuffles is one whose hot components Spark can split.
    least, _ = written(full.groupBy("component").agg(F.min("id").alias("component_id")), "components")
    out = full.join(least, "component").select("id", "n", "component_id").unionByName(empty)
    return out.select(F.col("id").alias(row_id), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df without near duplicates: of every component the one with the smallest id (null last), once.

    Texts without a word link with nothing and all stay.
    """
    docs = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows, labels = links(docs)
    named = rows.where("n > 0").join(labels, rows["key"] == labels["node"], "left").select("id", "key", F.coalesce("label", "key").alias("component"))
    best = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"))
    best = best.select(F.col("best.key").alias("__near_best"), F.col("best.id").alias("__near_id"))
    word = F.coalesce(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    tagged = with_keys(df.where(word), text, "__near_n", "__near_key")
    same = (F.col("__near_key") == F.col("__near_best")) & F.col(f"`{row_id}`").eqNullSafe(F.col("__near_id"))
    kept = tagged.join(best, same, "left_semi").dropDuplicates(["__near_key", row_id])
    columns = [F.col(f"`{c}`") for c in df.columns]
    return kept.select(*columns).unionByName(df.where(~word).select(*columns))


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM docs),
classes AS (SELECT min(rid) AS cid, s, len(s) AS n FROM (SELECT rid, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
grams AS (SELECT cid, n, unnest(s) AS g FROM classes),
links AS (SELECT a.cid AS u, b.cid AS v FROM grams a JOIN grams b ON a.g = b.g AND a.cid <> b.cid GROUP BY a.cid, b.cid HAVING 100 * count(*) >= 80 * (max(a.n) + max(b.n) - count(*))),
reach(u, v) AS (SELECT cid, cid FROM classes UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
label AS (SELECT u AS cid, min(v) AS label FROM reach GROUP BY u),
named AS (SELECT rid, doc_id, len(sets.s) AS n, label FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN label USING (cid))
SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY label) END AS component_id FROM named"""
