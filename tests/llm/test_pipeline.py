import hashlib
import re

import corpus_pipeline as C
from docmill.llm import pii as P

from .test_decontaminate import brute as leaks
from .test_mixing import targets
from .test_ngram_join import brute as groups
from .test_pii import surrogate_text
from .test_quality import plain


def quality_ok(text):
    m = plain(text)
    n = m["n_words"]
    return not (
        n < 50 or 100 * m["n_repeat_words"] > 50 * n or 10 * m["n_symbols"] > n or 10 * m["n_dup_lines"] > 4 * m["n_lines"] or 2 * m["n_upper"] > m["n_letters"] or m["word_chars"] < 3 * n or m["word_chars"] > 10 * n
    )


def test_stages_equal_a_plain_version(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    keep = {i: r.text for i, r in docs.items() if quality_ok(r.text)}
    keep = {i: keep[i] for i in {int(c) for _, _, c in groups(list(keep.items()))}}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = {int(i) for i, _, hit, _, _ in leaks(list(keep.items()), bench) if not hit}
    keep = {i: surrogate_text(t) for i, t in keep.items() if i in clean}
    sizes = {}
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    for i, t in keep.items():
        sizes[docs[i].source] = sizes.get(docs[i].source, 0) + count(t)
    want, goal = {}, targets(sizes)
    for i, t in keep.items():
        rate = goal[docs[i].source] / sizes[docs[i].source]
        u = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        if n := int(rate) + (u < rate - int(rate)):
            want[i] = (t, n)
    assert {r.doc_id: (r.text, r.copies) for r in C.run(spark, d).collect()} == want


def test_stages_on_odd_rows(spark, docs, sf, empty):
    names = [n for n, _ in C.STAGES]
    assert len(names) == 5
    now = docs
    for name, stage in C.STAGES:
        out = stage(spark, now.selectExpr("*", "'mine' AS size", "'mine' AS key"), sf)
        assert set(C.COLUMNS) <= set(out.columns), name
        assert stage(spark, empty, sf).count() == 0
        if name != "mixing":
            assert out.columns == list(C.COLUMNS)
            assert stage(spark, docs, sf).count() <= docs.count()
    assert C.near_duplicates(spark, docs, sf).where("doc_id IN (2, 3, 9)").count() == 0
    assert C.pii_surrogates(spark, docs, sf).count() == docs.count()
    assert P.MAX_SENT
