import gc
import random
import zlib
from glob import glob

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docmill.llm import ids as I
from docmill.llm import token_files as K

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def plain_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def brute(rows):
    """Rows of one id in any order: (doc_id, start, n_tokens, crc) of the ids read one after another."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain_ids(text), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


CACHES = {n: I.Cache(I.TokenizersFile(PATH), size=n) for n in (3, 40, 1 << 12)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab Z9'é  \n\t\r\x1c\x85\xa0　!<|endoftext>😀", max_size=40), max_size=6), st.sampled_from(sorted(CACHES)), st.sampled_from([None, 2]))
def test_ids_equal_the_library(texts, size, end):
    got, bounds = CACHES[size].ids(texts, end)
    assert [got[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain_ids(t) + ([end] if end else []) for t in texts]


def test_long_pieces_and_special_strings():
    texts = ["x" * 5000 + " " + "yz" * 3000, "<|endoftext|>", " <|endoftext|> a<|endoftext|>b", "word " * 2000]
    cache = I.Cache(I.TokenizersFile(PATH))
    for _ in range(2):
        got, bounds = cache.ids(texts)
        assert [got[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain_ids(t) for t in texts]
    assert max(map(len, (k for k in cache.index if isinstance(k, str)))) <= I.CACHED_CHARS


def test_other_kinds_of_tokenizers_go_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, cache = Tokenizer.from_file(path), I.Cache(I.TokenizersFile(path))
    texts = ["Some  Words\n here", "", "A <|endoftext|> b"]
    got, bounds = cache.ids(texts)
    assert not cache.library.cuts and [got[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("shard_bytes, encoding", [(1 << 30, "dictionary"), (9000, "delta")])
def test_equals_brute_force(spark, docs, rows, tmp_path, shard_bytes, encoding):
    K.written(docs, str(tmp_path), PATH, end=2, shard_bytes=shard_bytes, encoding=encoding)
    got = [tuple(r) for r in K.checksums(K.read(spark, str(tmp_path))).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    got.sort(key=lambda r: r[1])
    want = brute([(r[0], r[1]) for r in rows])
    assert [r[0] for r in got] == [r[0] for r in want]
    ends = np.cumsum([r[2] for r in got])
    assert [r[1] for r in got] == [0, *ends[:-1]]
    assert sorted((repr(r[0]), *r[2:]) for r in got) == sorted((repr(r[0]), *r[2:]) for r in want)
    single = {r[0] for r in want if [x[0] for x in want].count(r[0]) == 1}
    assert [r for r in got if r[0] in single] == [r for r in want if r[0] in single]
    shards = spark.read.parquet(f"{tmp_path}/shards").orderBy("shard").collect()
    assert (len(shards) > 3) == (shard_bytes == 9000) and sum(r.n_documents for r in shards) == len(rows)
    assert all(a.last_doc_id <= b.last_doc_id for a, b in zip(shards, shards[1:], strict=False) if a.last_doc_id is not None)


def test_hot_id_fills_many_shards(spark, tmp_path):
    """A third of the rows is one row, another third has its id with other texts."""
    rows = [(7, "the same words again " * 20)] * 300 + [(7, f"text {i} " * 30) for i in range(300)] + [(i, f"own {i} " * 30) for i in range(300)]
    K.written(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), str(tmp_path), PATH, end=2, shard_bytes=20_000)
    n = spark.read.parquet(f"{tmp_path}/shards").agg({"n_documents": "max"}).first()[0]
    assert n < 300
    got = sorted(K.read(spark, str(tmp_path)).select("start", "n_tokens", "doc_id").collect())
    assert [r[2] for r in got] == sorted(r[0] for r in rows) and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_layout_and_selective_reads(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "gamma", "delta", str(i)], k=300))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = f"{tmp_path}/{encoding}"
        K.written(df, path, PATH, end=2, encoding=encoding, group_bytes=64 << 10, page_rows=50)
        meta = pq.ParquetFile(glob(f"{path}/tokens/*.parquet")[0]).metadata
        columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
        assert meta.num_row_groups > 3 and name in columns[K.IDS].encodings
        assert all(c.has_column_index and c.has_offset_index for c in columns.values() if c.path_in_schema != K.IDS) and columns[K.IDS].has_offset_index
        few = K.read(spark, path).where("doc_id BETWEEN 100 AND 105")
        plan = few.select("start", "n_tokens")._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(doc_id,100)" in plan and "ids" not in plan.split("ReadSchema:")[1].split("\n")[0]
        assert [x.ids for x in few.orderBy("doc_id").collect()] == [[*plain_ids(rows[i][1]), 2] for i in range(100, 106)]


def test_odd_cases(spark, docs, empty, tmp_path):
    K.written(empty, f"{tmp_path}/none", PATH, end=2)
    assert K.checksums(K.read(spark, f"{tmp_path}/none")).count() == 0
    clash = docs.selectExpr("doc_id AS shard", "text AS ids", "1 AS doc_id", "'x' AS at")
    K.written(clash, f"{tmp_path}/clash", PATH, row_id="shard", text="ids")
    assert K.read(spark, f"{tmp_path}/clash").columns == ["doc_id", "start", "n_tokens", "ids"]
    assert sorted(r.ids for r in K.read(spark, f"{tmp_path}/clash").collect()) == sorted(plain_ids(r["text"]) for r in docs.collect())


def test_encoding_walks_no_lists_of_ids():
    """Ids of a batch hold no cycles, so they are made without the collector; parts of pieces met before aren't encoded again."""
    cache = I.Cache(I.TokenizersFile(PATH))
    texts = [" ".join(f"{a}{b}{m}\n{b}" for m in ("", ",", "?!")) for a in ("Größ", "stone", "été") for b in ("abcdefgh", "ijk", "ñandú")] + [f"w{'x' * i}" for i in range(200)]
    ran, model, encoded = [], cache.library.model, []
    cache.library.model = type("Model", (), {"tokenize": staticmethod(lambda s: encoded.append(s) or model.tokenize(s))})
    limits = gc.get_threshold()
    gc.callbacks.append(see := lambda phase, info: ran.append(phase))
    try:
        gc.set_threshold(20)
        gc.disable(), gc.collect(), gc.enable()
        ran.clear()
        seen = []
        words = cache.library.words
        cache.library.words = lambda w: (words(w), seen.append(len(ran)))[0]
        got, bounds = cache.ids(texts, 2)
    finally:
        gc.callbacks.remove(see)
        gc.set_threshold(*limits)
    assert seen == [0] and gc.isenabled()
    assert len(encoded) == len(set(encoded))
    assert [got[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*plain_ids(t), 2] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"asvl'’Z90.,-—“!  \n\n\t\r\x7f\x85\xa0\u2028\u3000×÷éɏжѿ҂α·中の😀\u0301²ª", "'s", "'ll", " the", "<|endoftext|>"]), max_size=25).map("".join), max_size=6), st.sampled_from(sorted(CACHES)))
def test_cuts_between_kinds_of_characters_equal_the_library(texts, size):
    got, bounds = CACHES[size].ids(texts, 2)
    assert [got[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*plain_ids(t), 2] for t in texts]


def test_marks_digits_and_line_ends_make_no_new_pieces():
    """A word is kept once behind a space and once without, whatever it stands between; a slice of a column is read as such."""
    cache = I.Cache(I.TokenizersFile(PATH))
    texts = ["left out", " ".join(f"{a}Größe{b}" for a in ("", "(", "7") for b in ("", ",", ".\nGröße", "!?", "42")), "", " Größe"]
    got, bounds = cache.ids(pa.array(texts, pa.large_string()).slice(1), 2)
    assert sorted(k for k in cache.index if isinstance(k, str) and "Größe" in k) == [" Größe", "Größe"]
    assert [got[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*plain_ids(t), 2] for t in texts[1:]]


def test_a_cache_of_size_none_keeps_no_pieces_of_earlier_texts():
    cache = I.Cache(I.TokenizersFile(PATH), size=0)
    for texts in (["often often often often"], ["other words"]):
        got, bounds = cache.ids(texts)
        assert [got[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain_ids(t) for t in texts]
    assert sorted(cache.index) == [" words", "other"]
