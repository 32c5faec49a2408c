import hashlib
import re

from pyspark.sql import functions as F

from docmill.llm import mixing as M


def targets(sizes, weights=(5, 2, 1), share=150, most=2):
    """Shares clipped at their caps, the excess shared again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()) * share / 100, set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def test_targets(spark):
    cases = [{"a": 100, "b": 100, "c": 100, None: 7}, {"a": 1, "b": 1000}, {"a": 0, "b": 0}, {None: 5}, {f"s{i:02d}": (i * 37) % 90 for i in range(20)}]
    for sizes in cases:
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in M.source_targets(df, "source", "size").collect()}
        want = targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want), (got, want)


def test_mix(spark, docs, rows, empty):
    out = M.mixed(docs.selectExpr("*", "'mine' AS size", "'mine' AS rate")).collect()
    assert len(out) == len(rows) and all(r["size"] == r["rate"] == "mine" for r in out)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = targets(sizes)
    for r in out:
        assert r[M.P + "size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert abs(r[M.P + "target"] - want[r.source]) < 1e-6
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        u = int(hashlib.md5(f"mix-1:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert r[M.P + "copies"] == int(rate) + (u < rate - int(rate)) <= 2
    assert M.mixed(empty).count() == 0 and M.emitted(empty).count() == 0


def test_emitted_rows(docs):
    copies = M.mixed(docs).agg(F.sum(M.P + "copies")).first()[0]
    out = M.emitted(docs)
    assert out.count() == copies and out.columns == docs.columns


def test_near_targets(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', 1 + id % 50) AS text", "concat('s', id % 3) AS source")
    for r in M.mixed(df).groupBy("source").agg(F.sum(F.col(M.P + "size") * F.col(M.P + "copies")).alias("taken"), F.first(M.P + "target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.03 * r.target
