"""Loading once, the enveloped file, and visited keys without a horizon."""

import json
import os

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import adapters
from docmill.functions import values as V
from docmill.operators import chunking, load
from docmill.sources import buckets, enveloped, tables
from docmill.streaming import incremental

KIND = "storage_path string, content binary, processor string"


def counting(spark, kind, value):
    """A function that counts its rows that aren't null."""
    n = spark.sparkContext.accumulator(0)

    @F.pandas_udf(kind)
    def f(x):
        import pandas as pd

        n.add(int(x.notna().sum()))
        return pd.Series([None if v is None else value(v) for v in x])

    return f, n


def test_each_chunk_is_embedded_once_and_each_file_read_by_its_reader(spark, tmp_path, monkeypatch):
    embed, embeds = counting(spark, "array<array<double>>", lambda texts: [[float(len(t)), 1.0] for t in texts])
    text, texts = counting(spark, "string", lambda b: bytes(b).decode())
    xml, xmls = counting(spark, "string", lambda b: "from xml " + bytes(b).decode())
    image, images = counting(spark, "string", lambda b: "an image of " + str(len(b)) + " bytes")
    monkeypatch.setattr(adapters, "EXTRACTORS", {"text": text, "xml": xml, "docx": None})
    files = [(f"s/{i}.txt", bytearray(b"a text of one part"), "text") for i in range(6)] + [("s/a.xml", bytearray(b"x"), "xml"), ("s/b.png", bytearray(b"12345"), "image"), ("s/c.tiff", bytearray(b"1"), "image"), ("s/d.png", bytearray(b""), "image"), ("s/e.pdf", bytearray(b"1"), "pdf"), ("s/known.txt", bytearray(b"old"), "text")]
    df = spark.createDataFrame(files, KIND).repartition(3)
    stored = spark.createDataFrame([("s/known.txt", "c", "old")], "storage_path string, chunk_id string, chunk_text string")
    table, outcomes = load.ingested(df, stored, overwrite=False, mode="whole", embedder=lambda t: embed(t), describer=lambda c: image(c))
    got = {r.storage_path: (r.outcome, r.chunks) for r in outcomes.collect()}
    assert got == {**{f"s/{i}.txt": ("processed", 1) for i in range(6)}, "s/a.xml": ("processed", 1), "s/b.png": ("processed", 1), "s/c.tiff": ("deleted", 0), "s/d.png": ("deleted", 0), "s/e.pdf": ("deleted", 0), "s/known.txt": ("skipped", 0)}
    rows = {r.storage_path: r.chunk_text for r in table.collect()}
    assert rows["s/a.xml"] == "from xml x" and rows["s/b.png"] == "an image of 5 bytes" and rows["s/known.txt"] == "old"
    assert (embeds.value, texts.value, xmls.value, images.value) == (8, 6, 1, 1)


def test_loading_into_buckets(spark, tmp_path):
    path = str(tmp_path / "v")
    buckets.create(spark.createDataFrame([], "storage_path string, chunk_text string, embedding array<double>, batch int"), path, buckets=8)
    files = lambda *named: spark.createDataFrame([(n, bytearray(t.encode()), "text") for n, t in named], KIND)
    load.stored_into(files(("a/1", "one"), ("a/2", "two")), path, mode="whole")
    outcomes = load.stored_into(files(("a/2", "new"), ("a/3", " ")), path, mode="whole")
    assert {r.storage_path: r.outcome for r in outcomes.collect()} == {"a/2": "processed", "a/3": "deleted"}
    assert {(r.storage_path, r.chunk_text, r.batch) for r in buckets.read(spark, path).collect()} == {("a/1", "one", 0), ("a/2", "new", 0)}


def test_a_load_into_buckets_leaves_only_the_table(spark, tmp_path, monkeypatch):
    files_of = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in map(str, str(files_of.getAllFiles().mkString("\n")).split("\n")) if "shuffle_" in f}
    kind = "storage_path string, page int, ordinal int, chunk_id string, chunk_text string, embedding array<double>, batch int, request int"
    files = spark.createDataFrame([(f"s/{i}.txt", bytearray("\n\n".join(f"words {j} of text {i} " * 60 for j in range(9)).encode()), "text") for i in range(60)], KIND).repartition(3)
    monkeypatch.setattr(tables, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    path, rows, left = str(tmp_path / "v"), [], set()
    buckets.create(spark.createDataFrame([], kind), path, buckets=4)
    # A whole load, the same again, and a part of it, which reads buckets that keep other paths.
    for part in (files, files, files.where("storage_path LIKE 's/1%'")):
        had = shuffled()
        outcomes = load.stored_into(part, path)
        left |= shuffled() - had
        assert outcomes.where("outcome = 'processed' AND chunks > 1").count() == part.count()
        rows.append(sorted(map(tuple, buckets.read(spark, path).collect())))
    assert rows[0] == rows[1] == rows[2] and len({r[0] for r in rows[0]}) == 60
    # What isn't the table: the outcomes, which are small; no shuffle files.
    assert all(name.startswith("docmill-outcomes-") for name in os.listdir(tmp_path / "shared")) and not left
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in (tmp_path / "v/rows").rglob("*.parquet")} == {"ZSTD"}
    # Numbers are made in a file's row.
    told = load.written(load.cut_up(files, buckets.read(spark, path)), "cut")
    assert "Exchange" not in load.vectors_of(told)._jdf.queryExecution().toString()


def test_files_of_one_path_are_numbered_together(spark):
    files = spark.createDataFrame([("a", bytearray(b"one\n\ntwo"), "text"), ("a", bytearray(b"three\n\nfour\n\n" + b"w " * 2000), "text"), ("b", bytearray(b"five"), "text"), (None, bytearray(b"six"), "text")], KIND)
    stored = spark.createDataFrame([], "storage_path string, page int, ordinal int, chunk_id string, chunk_text string, batch int")
    table, outcomes = load.ingested(files, stored)
    rows = table.collect()
    assert sorted((r.storage_path, r.ordinal) for r in rows) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)] and len({r.chunk_id for r in rows}) == 4
    assert sorted((r.storage_path or "", r.outcome, r.chunks) for r in outcomes.collect()) == [("", "deleted", 0), ("a", "processed", 3), ("a", "processed", 3), ("b", "processed", 1)]


def test_lists_of_texts_are_cut_as_single_texts_are(spark):
    texts = ["one two\n\nthree four\n\n" + "w " * 400, "é" * 90 + "\n\nshort", "", None, "\t\n", "x\n\n" * 900, "\n\n".join(f"alike {i % 5} " * 30 for i in range(40))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for how in ({}, {"mode": "greedy", "low": 3, "high": 40}, {"mode": "whole"}, {"most": 31}, {"mode": "whole", "most": 31}, {"mode": "greedy", "most": None}, {"low": 20, "high": 100, "most": None}):
        want = {i: [] for i in range(len(texts))}
        for r in chunking.chunked(df, **how).orderBy("i", "ordinal").collect():
            want[r.i] += [r.chunk] if r.chunk is not None else []
        listed = df.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("texts"))
        assert [x or [] for x in chunking.chunk_lists(listed, "texts", **how).first()["chunks"]] == [want[i] for i in range(len(texts))]


def test_a_file_of_white_space_has_no_chunks(spark):
    files = spark.createDataFrame([("w", bytearray(b"\t\n"), "text"), ("a", bytearray(b"one"), "text")], KIND)
    stored = spark.createDataFrame([], "storage_path string, chunk_text string")
    for mode in ("greedy", "semantic"):
        table, outcomes = load.ingested(files, stored, mode=mode, most=None)
        assert [tuple(r) for r in table.collect()] == [("a", "one")]
        assert {r.storage_path: (r.outcome, r.chunks) for r in outcomes.collect()} == {"w": ("deleted", 0), "a": ("processed", 1)}


def test_image_guard(spark):
    files = spark.createDataFrame([("a.png", bytearray(b"1"), "image"), ("a.PNG", bytearray(b"1"), "image"), ("a.tiff", bytearray(b"1"), "image"), ("a", None, "image"), ("a.x", None, None)], KIND)
    got = {r.storage_path: (r.status, r.message) for r in adapters.extracted(files, describer=lambda c: F.when(c.isNotNull(), F.lit("seen"))).collect()}
    assert got["a.png"] == got["a.PNG"] == ("success", "") and got["a.tiff"] == got["a"] == ("skipped", "image not supported: format or size") and got["a.x"][0] == "error"
    assert {r.status for r in adapters.extracted(files.where("processor = 'image'")).collect()} == {"skipped"}
    assert V.IMAGE_BYTES > 0


def test_enveloped_file(spark, tmp_path):
    rows = [(i, f"name è {i}\nline", [1, i], {"k": "v"}) if i % 3 else (i, None, None, None) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, name string, list array<long>, map map<string,string>").repartitionByRange(6, "id").sortWithinPartitions("id")
    path = str(tmp_path / "out.json")
    for part in (df, df.where("id < 7"), df.where("id < 0")):
        enveloped.write_enveloped(part, path, "https://source.example", "2024-01-02T03:04:05")
        want = {"metadata": {"total_records": part.count(), "processed_at": "2024-01-02T03:04:05", "source": "https://source.example"}, "records": [r.asDict(recursive=True) for r in part.orderBy("id").collect()]}
        with open(path, encoding="utf-8") as f:
            assert f.read() == json.dumps(want, ensure_ascii=False, indent=2)
        assert os.listdir(tmp_path) == ["out.json"]


def test_aborted_enveloped_file_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out.json")
    df = spark.range(100).repartition(4).select(F.when(F.col("id") == 57, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        enveloped.write_enveloped(df, path, "s", "t")
    assert os.listdir(tmp_path) == []


def test_visited_over_restarts(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType()), T.StructField("v", T.StringType())])
    runs = [[("a", 5, "x"), ("a", 3, "y"), ("b", 1, None), (None, 4, "null")] + [("hot", 100 + i, "h") for i in range(3000)], [("a", 1, "late"), ("c", 9, "z"), (None, 1, "again"), ("hot", 1, "h")], []]
    want = {"a": (3, "y"), "b": (1, None), None: (4, "null"), "hot": (100, "h")}
    for i, rows in enumerate(runs):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.visited(stream, ["k"], "n", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        if i:
            want["c"] = (9, "z")
        assert {r.k: (r.n, r.v) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()} == want
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_registered_loads_follow_their_sql_on_long_paragraphs(spark, tmp_path):
    import __spark_entry__

    # A paragraph above CHUNK_BYTES, alone and behind a short one: the stated rule counts tokens, not bytes.
    long = "word " * 9000 + "end"
    rows = [(1, long, "s"), (2, f"a b c\n{long}\nlast", "s"), (3, "short", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("ingest_pipeline", "ingest_vectors"):
        got = __spark_entry__.queries()[name](spark, str(tmp_path))
        want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_visited_keys_without_a_horizon_need_no_python_a_key(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])
    spark.createDataFrame([(i % 700, i) for i in reversed(range(7000))], schema).repartition(5).write.parquet(str(tmp_path / "in"))
    run = incremental.visited(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], "n", str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination()
    assert "TransformWithState" not in run._jsq.explainInternal(False)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(i, i) for i in range(700)]
