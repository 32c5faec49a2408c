import random
import zlib

import numpy as np

from docmill.llm import language as L


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in L.op7_language(spark, d).collect()}
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_presence_is_a_set():
    texts = [b"abab", b"", b"Ab"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    row, code = L.presence(data, offsets)
    want = {(i, n << 24 | int.from_bytes(g, "big")) for i, t in enumerate(texts) for n in (1, 2, 3) for k in range(len(t) - n + 1) for g in [t.lower()[k : k + n]]}
    assert set(zip(row.tolist(), code.tolist(), strict=True)) == want and len(row) == len(want)


def test_odd_cases(spark, docs, rows, empty):
    model = L.trained(docs)
    out = L.identified(docs.selectExpr("*", "'mine' AS h", "'mine' AS label", "0 AS score"), model)
    assert out.count() == len(rows) and out.where("h <> 'mine'").count() == 0
    for r in out.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    assert L.identified(empty, model).count() == 0
    assert L.trained(empty) is None
    assert {r.lang_pred for r in L.identified(docs, None).collect()} == {"und"}


def test_training_is_bounded_and_needs_labels(spark, docs):
    some = L.training_rows(docs, "text", "lang", rows=2, chars=100).collect()
    assert some and all(r.label and len(r.text) <= 100 for r in some) and len({(r.label, r.text) for r in some}) == len(some)
    many = spark.range(20_000).selectExpr("concat('text ', id) AS text", "if(id % 100 = 0, 'b', 'a') AS lang")
    drawn = {r.label: r.n for r in L.training_rows(many, "text", "lang", rows=100).groupBy("label").count().withColumnRenamed("count", "n").collect()}
    assert 150 < drawn["a"] < 340 and drawn["b"] == 200


def test_no_language_is_lost(spark):
    """Many texts, three texts over many rows, and few texts that are all very long."""
    english = spark.range(20_000).selectExpr("concat('the word and the number ', id, ' of them') AS text", "'en' AS lang")
    french = spark.range(20_000).selectExpr("element_at(array('le mot et la phrase', 'une autre phrase du texte', 'et les mots de la fin'), cast(id % 3 AS int) + 1) AS text", "'fr' AS lang")
    german = spark.range(500).selectExpr("concat(repeat('das Wort und der Satz von ihm ', 700), id) AS text", "'de' AS lang")
    rows = english.unionByName(french).unionByName(german)
    model = L.trained(rows)
    assert model.languages == ["de", "en", "fr"]
    out = L.identified(rows, model)
    assert out.where("lang_pred <> lang").count() == 0
    assert {r.label: r.n for r in L.training_rows(rows, "text", "lang").groupBy("label").agg({"h": "count"}).withColumnRenamed("count(h)", "n").collect()}["fr"] == 3


def test_a_label_without_bound_on_their_number(spark):
    rows = [(f"{chr(97 + k % 26)}{chr(97 + k // 26)} word{k} " * 5, f"l{k}") for k in range(450)]
    model = L.trained(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 450


def spectrum(text):
    b = text.encode()
    b = bytes(c + 32 if 65 <= c < 91 else c for c in b)
    return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}


def test_equal_to_direct_kernel_ridge():
    """With every text a landmark, the weights give what kernel ridge regression in the span of all texts gives, solved directly."""
    r = random.Random(3)
    make = {"x": "the and of in to".split(), "y": "der und von zu ein".split(), "z": "le et de la un".split()}
    texts = [" ".join(r.choices(make[k], k=r.randint(3, 9)) + ["w" + str(r.randint(0, 99))]) for k in "xyz" for _ in range(r.randint(6, 11))]
    labels = [next(k for k, v in make.items() if t.split()[0] in v) for t in texts]
    new = [" ".join(r.choices(make[k], k=4)) for k in "xyzxyz"]
    sets, fresh = [spectrum(t) for t in texts], [spectrum(t) for t in new]
    k = lambda a, b: np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])
    full = k(sets, sets)
    weight = np.array([1 / labels.count(y) for y in labels])
    target = np.array([[1.0 if y == lang else -1.0 for lang in "xyz"] for y in labels])
    # (K + ridge / weight) alpha = target is the dual of the weighted ridge problem.
    want = k(fresh, sets) @ np.linalg.solve(full + L.RIDGE * np.diag(1 / weight), target)
    got = L.fit(texts, labels, landmarks=len(texts)).scores(*L.packed(new))
    assert np.abs(got - want).max() < 1e-3
    assert np.allclose(L.kernel(new, texts), k(fresh, sets), atol=1e-6)


def test_one_label_may_hold_nearly_all_rows(spark):
    """A third of all rows and more under one label: no task ranks them, and the rare label is learned."""
    df = spark.range(5000).selectExpr("id AS doc_id", "if(id % 500 = 0, concat('eins zwei drei ', id), concat('one two three ', id)) AS text", "if(id % 500 = 0, 'de', 'en') AS lang")
    model = L.trained(df)
    out = L.identified(df, model)
    assert out.where("lang_pred = lang").count() == 5000
    assert "Window" not in L.training_rows(df, "text", "lang")._jdf.queryExecution().toString()
