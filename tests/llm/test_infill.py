import hashlib
import re

import pytest

from docmill.llm import infill as I


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", text, None, None
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = I.arranged(df)
    got = made.withColumn("restored", I.restored(made.output, made.form)).collect()
    want = sorted((repr(d), repr(t), *map(repr, brute(d, t))) for d, t in rows)
    assert sorted((repr(r.doc_id), repr(r.text), *map(repr, (r.n, r.form, r.output, r.prefix_chars, r.middle_chars))) for r in got) == want
    assert all(r.restored == (r.text or "") for r in got)
    return got


def test_equals_brute_force_and_round_trip(spark, rows):
    got = check(spark, [(r[0], r[1]) for r in rows])
    assert len(got) == len(rows)


def test_sentinels_half_sentinels_and_other_planes(spark):
    texts = ["<P>", "a<S>b", "<M", "<<P", "P>S>M><", "<S<S<M", "😀a😀😀b\U0010ffff", "é\r\n\t\x00 x", "<", "PSM", "<P <S <M> <", "a" * 50 + "<" * 50 + "S>" * 50]
    got = check(spark, [(i, t) for i in range(40) for t in texts])
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_long_text(spark):
    check(spark, [(1, "ab1 " * 250_000), (2, "x" * 1_000_000), (3, "é" * 300_000)])


@pytest.mark.parametrize("plain, spm, forms", [(100, 20, {"plain"}), (0, 100, {"spm"}), (0, 0, {"psm"})])
def test_shares(spark, plain, spm, forms):
    df = spark.createDataFrame([(i, "some words here") for i in range(50)], "doc_id long, text string")
    assert {r.form for r in I.arranged(df, plain_percent=plain, spm_percent=spm).collect()} == forms


def test_odd_cases(spark, docs, rows, empty):
    assert I.arranged(empty).count() == 0
    out = I.arranged(docs.selectExpr("*", "'mine' AS units", "'mine' AS form", "'mine' AS whole", "'mine' AS a"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "units", "whole", "a", "n", "form", "output", "prefix_chars", "middle_chars"]
    assert out.where("units <> 'mine' OR whole <> 'mine' OR a <> 'mine' OR form = 'mine'").count() == 0 and out.count() == len(rows)
    clash = I.arranged(docs.selectExpr("doc_id AS n", "text AS output"), row_id="n", text="output")
    assert clash.columns == list(I.NAMES) and clash.count() == len(rows)


def test_no_python_and_no_shuffle(spark, sf):
    plan = I.op13_fill_in_middle(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas", plan) and plan.count("regexp_extract_all") == 1
