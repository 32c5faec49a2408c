import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docmill.operators import chat, chunking, crawl, ingest, register, retrieval
from docmill.sources import tables
from docmill.streaming import incremental

# --- retrieval


def test_requests_are_checked():
    for bad in ({"libraries": ()}, {"libraries": ("x",)}, {"libraries": ("private",)}):
        with pytest.raises(ValueError):
            retrieval.Request([1.0], **bad)
    assert retrieval.clean_sources([" b", "a", "", "b "]) == ["a", "b"]


def vectors(spark):
    rows = [(1, [1.0, 0.0], "public", "s"), (2, [1.0, 0.0], "organization", None), (3, [0.0, 1.0], "public", "s"), (4, [0.0, 0.0], "public", "s"), (5, [0.9, 0.1], "private", "t"), (6, [1.0, 0.0], "private", "s")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, library string, source string")


def test_ties_keep_the_order_of_libraries(spark):
    request = retrieval.Request([1.0, 0.0], ("public", "organization", "private"), threshold=0.3, user="u")
    assert [r.vec_id for r in retrieval.by_library(vectors(spark), request).collect()] == [2, 6, 1, 5]
    only = retrieval.Request([1.0, 0.0], ("public", "organization"), sources=["s"])
    assert [r.vec_id for r in retrieval.by_library(vectors(spark), only).collect()] == [1]


def test_top_k_is_a_prefix(spark):
    r = random.Random(0)
    df = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(50)], "vec_id long, embedding array<float>")
    hits = retrieval.scored(df, [1.0, 0.2, 0.1, 0.4])
    five, six = ([x.vec_id for x in retrieval.top_k(hits, k, F.col("vec_id")).collect()] for k in (5, 6))
    assert six[:5] == five
    queries = df.where("vec_id < 7")
    a = {(x.query_id, x["rank"]): x.vec_id for x in retrieval.batch_top_k(df.repartition(3), queries, 4).collect()}
    assert a == {(x.query_id, x["rank"]): x.vec_id for x in retrieval.batch_top_k(df, queries, 4, block=2).collect()}
    assert all(a[i, 1] == i for i in range(7)) and len(a) == 28


def bm25_plain(docs, query):
    tok = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in docs}
    n, avg = len(tok), sum(map(len, tok.values())) / len(tok)
    df = {}
    for t in tok.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    return {i: sum((raw[q] if raw[q] >= 0 else floor) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for q in re.findall("[a-z0-9]+", query.lower()) if q in t) for i, t in tok.items()}


def test_bm25(spark):
    docs = [(1, "The cat sat"), (2, "the dog, the cat and the bird"), (3, ""), (4, "nothing here"), (5, "The the the")]
    df = spark.createDataFrame(docs, "pos long, text string")
    for order in (df, df.repartition(5)):
        got = {r.pos: r.score for r in retrieval.bm25(order, "the cat cat zebra").collect()}
        want = bm25_plain(docs, "the cat cat zebra")
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert [r.pos for r in retrieval.bm25_top(df, "!!", 2, F.col("pos")).collect()] == [1, 2]
    blank = spark.createDataFrame([(1, ""), (2, "")], "pos long, text string")
    assert [r.score for r in retrieval.bm25(blank, "cat").collect()] == [0.0, 0.0]


def test_first_of_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, ""), (5, None)], "pos int, text string")
    once = retrieval.first_of_text(df, "text", "pos")
    assert sorted(r.pos for r in once.collect()) == [1, 2] == sorted(r.pos for r in retrieval.first_of_text(once, "text", "pos").collect())


# --- chunking


def tokens(t):
    return int(len(t.split()) / 1.33)


def greedy_plain(parts, low, high):
    out, now = [], ""
    for p in parts:
        if not now:
            now = p
        elif tokens(now + "\n" + p) <= high or tokens(now) < low:
            now += "\n" + p
        else:
            out.append(now)
            now = p
    return [*out, now] if now else out


def vector(t):
    v = [0.0] * 16
    for w in re.findall("[a-z0-9]+", t.lower()):
        v[int(hashlib.md5(w.encode()).hexdigest()[0], 16)] += 1
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def semantic_plain(parts, low, high, like):
    out, now, mean, n = [], "", None, 0
    for p in parts:
        v = vector(p)
        if n:
            size = math.sqrt(sum(x * x for x in mean)) * math.sqrt(sum(x * x for x in v))
            alike = size > 0 and sum(a * b for a, b in zip(mean, v, strict=True)) / size >= like
            if tokens(now + "\n" + p) <= high and (tokens(now) < low or alike):
                n += 1
                now, mean = now + "\n" + p, [(a * n + b) / (n + 1) for a, b in zip(mean, v, strict=True)]
                continue
            out.append(now)
        now, mean, n = p, v, 1
    return [*out, now] if n else out


def test_chunks_equal_plain_folds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    parts = chunking.paragraphs(F.col("text"), "\n")
    from docmill.functions import values as V

    out = docs.select("text", chunking.greedy(parts, 30, 100, "\n").alias("g"), chunking.semantic(parts, V.hashed_vectors(parts), 30, 100, 0.6, "\n").alias("s")).collect()
    for r in out:
        lines = [p.strip() for p in r.text.split("\n") if p.strip()]
        assert r.g == greedy_plain(lines, 30, 100)
        assert r.s == semantic_plain(lines, 30, 100, 0.6)


def test_split_keeps_every_character(spark):
    texts = ["é" * 50, "a\n" * 40, "one very long line " * 9 + "\nshort\n\n\n", "x" * 10, "", "日本語\n" * 11]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select("i", "text", chunking.split_oversized(F.col("text"), 31).alias("p")).collect():
        assert all(len(p.encode()) <= 31 and p.strip() for p in r.p)
        assert "".join(r.p).replace("\n", "") == r.text.replace("\n", "")


def test_packing_and_batches(spark):
    sizes = [5, 5, 20, 1, 9, 10]
    got = spark.range(1).select(chunking.packed(F.array(*[F.lit(x).cast("long") for x in sizes]), 10)).first()[0]
    assert got == [0, 0, 1, 2, 2, 3]
    df = spark.createDataFrame([("k", i) for i in range(200)], "k string, i int")
    assert [r.batch for r in chunking.fixed_batches(df, "k", "i").orderBy("i").collect()] == [i // 96 for i in range(200)]


def test_chunked_modes(spark):
    df = spark.createDataFrame([("d", 1, "one two\n\nthree four\n\n" + "w " * 400)], "path string, page int, text string")
    for mode in ("semantic", "greedy", "whole"):
        out = chunking.with_ids(chunking.chunked(df, mode), "path", "page").orderBy("ordinal").collect()
        assert [r.ordinal for r in out] == list(range(len(out))) and len({r.chunk_id for r in out}) == len(out)
    assert len(out) == 1


# --- ingest


def test_outcomes(spark):
    rows = [
        ("a", "success", "", False, False, "processed"), ("b", "skipped", "type unsupported", False, False, "deleted"), ("c", "skipped", "later", False, False, "skipped"), ("d", "error", "No document processor available", False, False, "deleted"),
        ("e", "error", "No chunks generated", False, False, "deleted"), ("f", "error", "x", False, False, "failed"), ("g", None, "No /Root object", False, True, "deleted"), ("h", None, "boom", False, True, "failed"), ("i", "success", "", True, False, "skipped"),
        ("j", "error", None, False, False, "failed"),
    ]
    df = spark.createDataFrame(rows, "storage_path string, status string, message string, known boolean, raised boolean, want string")
    got = df.withColumn("outcome", ingest.outcome(F.col("status"), F.col("message"), F.col("known"), F.col("raised")))
    assert got.where("outcome <> want").count() == 0
    total = ingest.summary(got.withColumn("chunks", F.lit(2)).withColumn("upserted", F.lit(3))).first()
    assert (total.total_files, total.processed, total.failed, total.total_chunks, total.exit_code) == (10, 1, 3, 2, 0)
    sample = ingest.error_sample(got, 2).collect()
    assert [r.storage_path for r in sample] == ["f", "h"] and {r.more for r in sample} == {1}


def test_tables_in_part(spark):
    df = spark.createDataFrame([("a/x", "a"), ("ab/x", "ab"), ("b/y", None)], "storage_path string, source string")
    left = lambda **kw: sorted(r.storage_path for r in ingest.deleted(df, **kw).collect())
    assert left(path="a/x") == ["ab/x", "b/y"] and left(source="ab") == ["a/x", "b/y"] and left(prefix="a") == ["b/y"]
    for bad in ({}, {"path": "x", "prefix": "y"}):
        with pytest.raises(ValueError):
            ingest.deleted(df, **bad)
    assert sorted(r.storage_path for r in df.where(ingest.under_folder(F.col("storage_path"), "a")).collect()) == ["a/x"]
    new = spark.createDataFrame([("a/x", "n"), ("c", "n")], "storage_path string, source string")
    once = ingest.replaced(df, new, "storage_path")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, ingest.replaced(once, new, "storage_path").collect()), key=str)
    assert [r[0] for r in df.select(ingest.normalized_path(F.col("storage_path"), "a")).collect()] == ["a/x", "a/ab/x", "a/b/y"]
    out = ingest.stored_outcome(spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "storage_path string, size long"), spark.createDataFrame([("p", 1), ("q", 9)], "storage_path string, size long"), True)
    assert {r.storage_path: r.outcome for r in out.collect()} == {"p": "unchanged", "q": "replaced", "r": "created"}


def test_orders_and_stops(spark):
    listing = spark.createDataFrame([("l", i, f"k{i}") for i in range(6)] + [("m", 0, "z")], "lane string, pos int, key string")
    stored = spark.createDataFrame([("k3",), ("k4",)], "key string")
    assert sorted(r.key for r in ingest.take_while_new(listing, stored, "key", "lane", "pos").collect()) == ["k0", "k1", "k2", "z"]
    assert sorted(r.key for r in ingest.resumed(listing.where("lane = 'l'"), "key", "k4", "pos").collect()) == ["k4", "k5"]
    assert ingest.resumed(listing, "key", "none", "pos").count() == 7
    pages = spark.createDataFrame([("l", i, n) for i, n in enumerate([3, 0, 2, 0, 0, 5])], "lane string, pos int, n_new int")
    assert sorted(r.pos for r in ingest.stop_after_idle(pages, "lane", "pos").collect()) == [0, 1, 2, 3, 4]
    segments = spark.createDataFrame([("l", i, t) for i, t in enumerate(["a", "b", "a", "c", "a", "b", "c", "d"])], "lane string, pos int, text string")
    assert [r.text for r in ingest.abort_after_repeats(segments, "lane", "pos", "text", 2).orderBy("pos").collect()] == ["a", "b", "c"]
    facts = spark.createDataFrame([("x", "u1", 1), ("x", "u2", 2)], "name string, url string, at int")
    out = {r.name: (r.path, r.matched) for r in ingest.rewritten(spark.createDataFrame([("x", "old"), ("y", "old")], "name string, path string"), facts, "name", "url", "path", "at").collect()}
    assert out == {"x": ("u2", True), "y": ("old", False)}


# --- register

TEXT = "Iscritto : ROSSI MARIA Nato a : Modena il : 01/02/1970\nOrdine di : Modena\nData anzianità : 03/04/2000\nTitolo professionale : Dottore\nRevisore contabile : si \nIscritto all'Albo : 05/06/2001\nSezione : A\nSede studio : Via X\n"


def test_register(spark):
    got = register.extracted(spark.createDataFrame([(TEXT,), ("",)], "text string")).collect()
    a = got[0]
    assert (a.nome_completo, a.luogo_nascita, a.data_nascita, a.ordine, a.data_iscrizione, a.sezione, a.revisore_contabile) == ("ROSSI MARIA", "Modena", "01/02/1970", "Modena", "05/06/2001", "A", "si")
    assert all(getattr(got[1], f) == "" for f in register.FIELDS)
    rows = [("41121", " A ", "M", "si ", "A", "x", "2001-06-05", 1), ("41121", "A", "M", "no", "", "", "", 2), ("", "", "", "", None, "", "", 3), ("41122", "B", "", "SI", None, "y", "boh", 4)]
    df = spark.createDataFrame(rows, "cap_code string, nome_completo string, ordine string, revisore_contabile string, sezione string, sede_studio string, data_iscrizione string, pos int")
    clean = register.cleaned(df)
    assert {(r.pos, r.nome_completo, r.revisore_contabile, r.data_iscrizione) for r in clean.collect()} == {(1, "A", "SI", "05/06/2001"), (2, "A", "NO", ""), (4, "B", "SI", "boh")}
    first = register.keep_first(clean, ["cap_code", "nome_completo"], "pos")
    assert sorted(r.pos for r in first.collect()) == [1, 4]
    s = register.statistics(first).first()
    assert (s.total, s.caps, s.orders, s.names, s.with_office, s.auditors) == (2, 2, 1, 2, 2, 2)
    assert {r.section: r.n for r in register.by_section(df).collect()} == {"A": 1, "": 1, "Unknown": 2}
    caps = spark.createDataFrame([("00100",), ("001xx",), ("00100",), ("---",)], "cap_code string")
    assert [r.cap_code for r in register.numeric_caps(caps).collect()] == ["00100"]
    pairs = spark.createDataFrame([("CAP", "Comune", 0), ("00100", "Roma", 1), ("001xx", "Roma", 2), ("00100", "Roma", 3), ("00100", "12345 x", 4)], "cap_code string, comune string, pos int")
    assert sorted(map(tuple, register.postal_rows(pairs).collect())) == [("00100", "Roma"), ("001xx", "Roma")]
    assert spark.range(1).select(register.pager_total(F.lit("1 di  37"))).first()[0] == 37


# --- crawl and chat


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("d", "e")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("x",)], "node string")
    assert {r.node: r.depth for r in crawl.closure(edges, roots).collect()} == {"a": 0, "b": 1, "c": 2, "x": 0, "y": 1}
    wanted = spark.createDataFrame([("Leggi",), ("news",), ("zzz",)], "name string")
    sections = spark.createDataFrame([("leggi e decreti", 0), ("Leggi", 1), ("News 2024", 2)], "name string, pos int")
    assert {r.wanted: r.section for r in crawl.section_choice(wanted, sections).collect()} == {"Leggi": "Leggi", "news": "News 2024", "zzz": None}
    items = spark.createDataFrame([("p", 0, "One", None), ("p", 1, None, "a"), ("p", 2, None, "b"), ("p", 3, "Two", None), ("p", 4, None, "c"), ("p", 5, None, "d"), ("p", 6, "Three", "e")], "page string, pos int, h string, link string")
    assert sorted(r.link for r in crawl.section_documents(items, "page", "pos", "h", "link", "One", "Two").collect()) == ["a", "c", "d"]
    years = spark.createDataFrame([("2023",), ("2023",), ("2024",), (None,)], "year string")
    assert {r.year: r.n for r in crawl.files_per_year(years).collect()} == {"2023": 2, "2024": 1, "TOTAL": 3}
    ok = lambda c: spark.range(1).select(c).first()[0]
    assert ok(crawl.is_document(F.lit("https://h/a.PDF?x"))) and ok(crawl.child_of(F.lit("/a/1-b/c"), F.lit("/a/1-b"))) and not ok(crawl.child_of(F.lit("/a/1-b/"), F.lit("/a/1-b")))
    assert ok(crawl.related(F.array(F.lit("short"), F.lit("long enough")))) == ["long enough"] and ok(crawl.related(F.array(F.lit("x")))) is None


def test_closure_goes_to_the_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(18)] + [(18, 0)], "src long, dst long").coalesce(1)
    root = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.depth for r in crawl.closure(edges, root).collect()} == {i: i for i in range(19)}
    with pytest.raises(RuntimeError):
        crawl.closure(edges, root, 3)


def test_chat(spark):
    rows = [("c", 1, "user", "hi", "sent"), ("c", 2, "assistant", "yes", "generated"), ("c", 3, "user", "bad", "error"), ("c", 4, "user", "more", "sent")]
    df = spark.createDataFrame(rows, "conv string, turn int, role string, text string, status string")
    h = chat.history(df, "conv", "turn").first()
    assert h.history == "user: hi\nassistant: yes\nuser: more" and h.n_messages == 3
    assert [r.turn for r in chat.latest(df, "conv", "turn", 2).orderBy("rank").collect()] == [4, 3]
    ok = lambda c: spark.range(1).select(c).first()[0]
    assert ok(chat.full_context(F.lit(""), F.lit("k"))) == "<<<Knowledge Base>>>\nk" and ok(chat.full_context(F.lit(None), F.lit(""))) == ""
    assert abs(ok(chat.cost(F.lit(1000), F.lit(1000))) - 0.00023) < 1e-12
    use = spark.createDataFrame([(10, 2, 12, "success"), (20, 4, None, "success"), (None, None, None, "error")], "tokens_in long, tokens_out long, cache_read long, status string")
    u = chat.usage(use).first()
    assert (u.mean_in, u.mean_out, u.mean_fresh, u.n_success, u.n_error) == (15.0, 3.0, 10.0, 2, 1)


# --- sources and streams


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_bytes("città".encode("latin-1"))
    (tmp_path / "d/a_output.txt").write_text("no")
    (tmp_path / "list.json").write_text('[{"a": "1"}, {"a": "2"}]')
    (tmp_path / "held.json").write_text('{"metadata": {}, "records": [{"a": "3"}]}')
    (tmp_path / "lines.json").write_text('{"a": "4"}\n{"a": "5"}\n')
    assert [r.text for r in tables.texts(spark, str(tmp_path / "d")).collect()] == ["città"]
    assert {n: sorted(r.a for r in tables.records(spark, str(tmp_path / f"{n}.json"), "a: string").collect()) for n in ("list", "held", "lines")} == {"list": ["1", "2"], "held": ["3"], "lines": ["4", "5"]}
    df = spark.createDataFrame([("x y", "1"), ("z/z", "2")], "k string, v string")
    tables.write_by_group(df, str(tmp_path / "groups"), "k")
    assert sorted(p.name for p in (tmp_path / "groups").iterdir() if p.is_dir()) == ["export_name=x_y", "export_name=zz"]
    assert tables.write_absent(df, str(tmp_path / "t"), "k").count() == 2 and tables.write_absent(df, str(tmp_path / "t"), "k").count() == 0
    tables.write_lines(df, str(tmp_path / "l"))
    tables.write_lines(df, str(tmp_path / "l"))
    assert tables.count_lines(spark, str(tmp_path / "l")) == 4
    tables.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "c"), sep=";", header=True).collect())) == [("x y", "1"), ("z/z", "2")]
    tables.write_enveloped(df, str(tmp_path / "e"), "s", "2024-01-01")
    assert spark.read.json(str(tmp_path / "e/metadata")).first().total_records == 2
    failed = spark.createDataFrame([("p", "read", "boom", "failed"), ("q", "read", "", "processed")], "storage_path string, step string, message string, outcome string")
    assert tables.failure_report(failed, str(tmp_path / "r")) == 1 and spark.read.text(str(tmp_path / "r")).first().value == "p | read | boom"
    assert {r.processor for r in tables.files(spark, str(tmp_path / "d")).collect()} == {"text"}


def test_second_run_of_a_stream_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, t string")
    df.write.parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"))
    incremental.load_new(*args, str(tmp_path / "state"), "id").awaitTermination()
    incremental.load_new(*args, str(tmp_path / "state"), "id").awaitTermination()
    incremental.load_new(*args, str(tmp_path / "other"), "id").awaitTermination()  # a lost checkpoint doubles nothing
    df.union(spark.createDataFrame([(99, "new")], df.schema)).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.load_new(*args, str(tmp_path / "state"), "id").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [*range(20), 99]


def test_stream_with_state(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 02:00:00")], "k long, ts string").selectExpr("k", "cast(ts AS timestamp) ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))
    q = incremental.first_seen(stream, ["k"], "ts").writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s1")).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2
    q = incremental.windowed_counts(stream, "ts", "k").writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s2")).start()
    q.awaitTermination()
    assert {(r.k, r.n) for r in spark.table("wins").collect()} == {(1, 1), (2, 1)} and spark.table("wins").count() == 3
