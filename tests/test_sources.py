"""Relational reads in ranges, statistics merged over loads, page plans, register exports, stored addresses."""

import json
import random

from pyspark.sql import functions as F

from docmill.operators import ingest, pages, register, summaries
from docmill.sources import relational


def test_relational_table_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(i, f"body {i}", i % 7) for i in range(5, 2005)]
    spark.createDataFrame(rows, "id long, body string, kind long").coalesce(1).write.format("jdbc").options(url=url, dbtable="messages", createTableColumnTypes="body VARCHAR(50)").save()
    df = relational.partitioned(spark, url, "messages", "id", 8)
    assert df.rdd.getNumPartitions() == 8 and sorted(map(tuple, df.collect())) == rows
    few = df.where("kind = 3 AND id > 100").select("body")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(KIND,3)" in plan.upper().replace("EQUALTO(", "EqualTo(") or "*EqualTo(kind,3)" in plan
    assert "ReadSchema: struct<body:string>" in plan.replace("BODY", "body") and few.count() == sum(k == 3 and i > 100 for i, _, k in rows)
    spark.createDataFrame([], "id long, body string").write.format("jdbc").options(url=url, dbtable="nothing", createTableColumnTypes="body VARCHAR(50)").save()
    assert relational.partitioned(spark, url, "nothing", "id").count() == 0


def test_statistics_are_merged_and_replaced(spark, tmp_path):
    r = random.Random(3)
    path = str(tmp_path / "s")
    kind = "g string, v double, d long"
    loads = {f"l{k}": [(r.choice(["a", "b", None]), r.choice([None, r.gauss(10, 3)]), r.randint(0, 3000)) for _ in range(3000)] for k in range(4)}
    for name, rows in [*loads.items(), ("l2", loads["l2"]), ("empty", [])]:
        summaries.add(summaries.summarized(spark.createDataFrame(rows, kind), name, "g", "v", "d"), path)
    got = {x["group"]: x for x in summaries.merged(spark, path).collect()}
    every = [row for rows in loads.values() for row in rows]
    for g in ("a", "b", None):
        own = [row for row in every if row[0] == g]
        values = sorted(v for _, v, _ in own if v is not None)
        x = got[g]
        assert x.n == len(own) and abs(x.total - sum(values)) < 1e-6 and (x.least, x.most) == (values[0], values[-1])
        exact = len({d for _, _, d in own})
        assert abs(x.n_distinct - exact) <= 0.02 * exact * 2
        for q in (50, 90):
            rank = sum(v <= x[f"q{q}"] for v in values) / len(values)
            assert abs(rank - q / 100) < 0.02
    # A load that comes later reads and adds its own rows alone.
    summaries.add(summaries.summarized(spark.createDataFrame([("new", None, 1)], kind), "l9", "g", "v", "d"), path)
    new = summaries.merged(spark, path).where(F.col("group") == "new").first()
    assert (new.n, new.total, new["mean"], new.q50, new.n_distinct) == (1, None, None, None, 1)


def test_page_plan_rules(spark):
    own = [("f", 1, "one", b"1"), ("f", 2, "bad (cid:3)", b"2"), ("f", 3, None, b"3"), ("scan", 1, " ", b"s1"), ("scan", 2, None, b"s2"), ("long", 1, "x", b"")] + [("long", i, "x", b"") for i in range(2, 8)] + [("late", i, "", b"p%d" % i) for i in range(1, 5)]
    images = [("f", 1, 0, b"A"), ("f", 2, 0, b"B"), ("f", 2, 1, b"A"), ("f", 3, 0, b"B"), ("scan", 2, 0, b"A"), ("long", 1, 0, b"Z")]
    p = spark.createDataFrame([(k, n, t, bytearray(c)) for k, n, t, c in own], "storage_path string, page int, text string, content binary")
    i = spark.createDataFrame([(k, n, o, bytearray(c)) for k, n, o, c in images], "storage_path string, page int, pos int, content binary")
    say = lambda w: lambda c: F.concat(F.lit(w), c.cast("string"))
    out = pages.page_texts(p, i, say("image "), say("ocr "), most=6, fallback=3)
    got = {(x.storage_path, x.page): x.text for x in out.collect()}
    assert got == {("f", 1): "one\n\nimage A", ("f", 2): "image B", ("scan", 1): "ocr s1", ("scan", 2): "ocr s2\n\nimage A", ("late", 1): "ocr p1", ("late", 2): "ocr p2", ("late", 3): "ocr p3"}
    assert {x.storage_path: x.text for x in pages.file_text(out).collect()}["late"] == "ocr p1\n\nocr p2\n\nocr p3"


def test_register_exports(spark, tmp_path):
    rows = [(1, " Anna B ", "Roma", "1-2-1970", "si", "A", "Via 1", "00100"), (2, "Anna B", "Roma", "01/02/1970", "no", "A", "Via 2", "00100"), (3, "Carl D", "Milano", None, "no", None, "", ""), (4, "", "", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "n int, nome_completo string, ordine string, data_nascita string, revisore_contabile string, sezione string, sede_studio string, cap_code string")
    kept, stats = register.processed(df, str(tmp_path), "https://s.example", "2024-01-01", "n")
    assert sorted(r.n for r in kept.collect()) == [1, 3]
    assert {r.stage: (r.total, r.names) for r in stats.collect()} == {"before": (4, 3), "after": (2, 2)}
    with open(tmp_path / "records.json", encoding="utf-8") as f:
        assert json.load(f)["metadata"]["total_records"] == 2
    assert spark.read.csv(str(tmp_path / "records.csv"), sep=";", header=True).count() == 2 and len(list((tmp_path / "by_ordine").glob("export_name=*"))) == 2


def test_addresses_in_headers(spark):
    texts = ["url: https://a/1\ntitle: x", "title: y\nURL: 'https://a/2'\n---", "\n" * 10 + "url: https://a/3", "no header", None, ""]
    listing = spark.createDataFrame([(f"https://a/{i}",) for i in range(1, 5)], "url string")
    stored = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sorted(r.url for r in ingest.not_stored_by_header(listing, stored).collect()) == ["https://a/3", "https://a/4"]
