"""Inverted files, bucketed tables, containment joins and paged crawls against plain versions."""

import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmill.operators import crawl, names, nearest, retrieval
from docmill.sources import buckets


def clustered(n=6000, size=24, groups=60, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, size))
    group = np.where(r.random(n) < 0.33, 0, r.integers(0, groups, n))  # one group holds a third
    return (centres[group] + 0.15 * r.normal(size=(n, size))).astype(np.float32)


def test_nearest_reads_few_rows_of_clustered_data(spark, tmp_path):
    v = clustered()
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(90001, None), (90002, []), (90003, [0.0] * 24), (90004, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    index = nearest.build(vectors, str(tmp_path / "i"), recall=0.97)
    asked = vectors.where("vec_id % 50 = 0")
    found = {}
    for r in nearest.search(spark, str(tmp_path / "i"), asked, 10).collect():
        found.setdefault(r.query_id, {})[r.id] = r.score
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = []
    for q in range(0, len(v), 50):
        score = u[q] @ u.T
        best = np.argsort(-score, kind="stable")[:10]
        hits.append(len(set(best.tolist()) & set(found[q])) / 10)
        assert all(abs(score[i] - s) < 1e-4 for i, s in found[q].items())
    assert np.mean(hits) >= 0.95
    some = v[[q for q in range(0, len(v), 50)]]
    # A third of the rows is in one group, so its own queries read that much; the others read little.
    assert index.share(some) < 0.2 and index.rows.sum() == len(v)
    again = nearest.Index.at(spark, str(tmp_path / "i"))
    assert again.probes == index.probes and np.allclose(again.centres, index.centres)
    plan = nearest.search(spark, str(tmp_path / "i"), vectors.where("vec_id = 100"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:60]


def test_nearest_odd_cases(spark, tmp_path):
    kind = "vec_id long, embedding array<float>"
    nearest.build(spark.createDataFrame([], kind), str(tmp_path / "none"))
    assert nearest.search(spark, str(tmp_path / "none"), spark.createDataFrame([(1, [1.0])], kind), 3).count() == 0
    same = spark.createDataFrame([(i % 5, [1.0, 2.0]) for i in range(20)] + [(9, [2.0, -1.0])], kind)
    nearest.build(same, str(tmp_path / "same"))
    got = nearest.search(spark, str(tmp_path / "same"), same.where("vec_id = 9"), 30, probes=99).collect()
    assert sorted(r.id for r in got) == sorted([i % 5 for i in range(20)] + [9]) and got[0].rank == 1


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{path}/rows") for f in fs if f.endswith(".parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"a/{i}", f"v{i}", "s1" if i % 3 else "s2") for i in range(300)] + [("hot", f"h{i}", "s1") for i in range(500)] + [(None, "null", None)]
    kind = "storage_path string, text string, source string"
    buckets.create(spark.createDataFrame(rows, kind), path, buckets=32)
    before = files(path)
    wrote = buckets.upsert(spark.createDataFrame([("a/7", "new", "s1"), ("b/1", "own", "s1"), ("b/1", "two", "s1"), (None, "other", None)], kind), path)
    after = files(path)
    of = lambda f: int(f.split("bucket=")[1].split("/")[0])
    assert {of(f) for f in before ^ after} == set(wrote) and len(wrote) <= 3
    want = sorted([r for r in rows if r[0] not in ("a/7", None)] + [("a/7", "new", "s1"), ("b/1", "own", "s1"), ("b/1", "two", "s1"), (None, "other", None)], key=repr)
    read = lambda: sorted(map(tuple, buckets.read(spark, path).collect()), key=repr)
    assert read() == want
    assert buckets.upsert(spark.createDataFrame([], kind), path) == [] and files(path) == after
    assert len(buckets.delete(spark, path, key="hot")) == 1 and buckets.delete(spark, path, key="absent") == []
    buckets.delete(spark, path, source="s2")
    buckets.delete(spark, path, prefix="b/")
    assert read() == [r for r in want if r[0] != "hot" and r[2] != "s2" and not (r[0] or "").startswith("b/")]
    with pytest.raises(ValueError):
        buckets.delete(spark, path)
    buckets.delete(spark, path, prefix="a/")
    assert [r[0] for r in read()] == [None]


def test_bucketed_tables_from_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    kind = "storage_path string, text string, source string"
    buckets.create(spark.createDataFrame([], kind), path)
    assert buckets.read(spark, path).count() == 0 and buckets.delete(spark, path, prefix="x") == []
    buckets.upsert(spark.createDataFrame([("x", "1", None)], kind), path)
    assert [tuple(r) for r in buckets.read(spark, path).collect()] == [("x", "1", None)]


def test_containment_equals_nested_loop(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abAB ") for _ in range(r.randint(0, 7)))
    left, right = [word() for _ in range(300)] + [None, ""], [word() for _ in range(300)] + [None, "", "ÀBC", "😀ab"]
    a, b = (spark.createDataFrame([(x,) for x in side], "name string") for side in (left, right))
    found = names.containment(a, b)
    want = {(x, y) for x in {s.lower() for s in left if s is not None} for y in {s.lower() for s in right if s is not None} if x in y or y in x}
    got = [tuple(x) for x in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString() and "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_section_choice_equals_nested_loop(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abA") for _ in range(r.randint(0, 5)))
    wanted, sections = [word() for _ in range(80)], [(word(), i) for i in range(60)]
    got = {x.wanted: x.section for x in crawl.section_choice(spark.createDataFrame([(w,) for w in wanted], "name string"), spark.createDataFrame(sections, "name string, pos int")).collect()}
    for w in wanted:
        near = [(s != w, pos, s) for s, pos in sections if s.lower() == w.lower() or s.lower() in w.lower() or w.lower() in s.lower()]
        assert got[w] == (min(near)[2] if near else None)


def test_ranked_pages_of_long_chains_and_cycles(spark):
    edges = [(f"a{i}", f"a{i + 1}") for i in range(700)] + [(f"c{i}", f"c{(i + 1) % 37}") for i in range(37)] + [("t0", "t1"), ("t1", "c5"), ("s", "s"), ("x", None)]
    starts = [("A", "a0"), ("C", "c3"), ("T", "t0"), ("S", "s"), ("B", "a650"), ("N", "x")]
    got = {(r.lane, r.page): r.pos for r in crawl.ranked_pages(spark.createDataFrame(edges, "page string, next string"), spark.createDataFrame(starts, "lane string, page string")).collect()}
    step, want = dict(edges), {}
    for lane, page in starts:
        pos = 0
        while page is not None and (lane, page) not in want:
            want[lane, page] = pos
            page, pos = step.get(page), pos + 1
    assert got == want


def test_category_crawl_equals_a_walk(spark):
    r = random.Random(9)
    edges, items, starts = [], [], [(f"l{k}", k * 100) for k in range(6)]
    for k in range(6):
        edges += [(k * 100 + i, k * 100 + i + 1) for i in range(20)]
        items += [(k * 100 + i, r.randint(0, 25)) for i in range(21) for _ in range(3)]
    stored = [(i,) for i in range(5)]
    new, counters = crawl.category_crawl(*(spark.createDataFrame(x, kind) for x, kind in ((edges, "page long, next long"), (starts, "lane string, page long"), (items, "page long, item long"), (stored, "item long"))))
    want_new, want_counts = set(), {}
    for lane, first in starts:
        have, quiet, pages, seen, known = set(), 0, 0, 0, set()
        n_new = 0
        for i in range(21):
            page = first + i
            on = {x for p, x in items if p == page}
            fresh = {x for x in on if x >= 5 and x not in have}
            known |= {x for x in on if x < 5}
            want_new |= {(lane, x, page, i) for x in fresh}
            have |= on
            pages, seen, n_new = pages + 1, seen + len(on), n_new + len(fresh)
            quiet = quiet + 1 if not fresh else 0
            if quiet == 2:
                break
        want_counts[lane] = (pages, seen, n_new, seen - len(have), len(known))
    assert {tuple(x) for x in new.collect()} == want_new
    assert {x.lane: (x.pages, x["seen"], x.new, x.repeated, x.known) for x in counters.collect()} == want_counts


def test_exact_way_stays(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in retrieval.batch_top_k(v, v.where(F.col("vec_id") == 0), 1).collect()] == [0]


def test_containment_broadcasts_no_postings(spark, tmp_path):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("ab1"), n))
    small = sorted({word(int(n)) for n in rng.integers(1, 14, 200)})
    large = sorted({word(int(n)) for n in rng.integers(1, 30, 200)} | {"x" + s + "y" for s in small[::3]})
    a, b = (spark.createDataFrame([(s,) for s in side], "name string") for side in (small, large))
    for df, at in ((a, "a"), (b, "b")):
        df.write.parquet(str(tmp_path / at))
    a, b = (spark.read.parquet(str(tmp_path / at)) for at in "ab")  # a few KB, as Spark estimates them
    found = names.contained(a, b)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(x, y) for x in small for y in large if x in y}
    assert {tuple(r) for r in names.containment(a, b).collect()} == {(x, y) for x in small for y in large if x in y or y in x}


def test_batch_top_k_ranks_equal_vectors_by_id_in_small_tiles(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((5, 8))
    rows = [(i, [float(x * (1 + 0.37 * i)) for x in base[i % 5]]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = retrieval.batch_top_k(df, df.where("vec_id < 5"), 7).orderBy("query_id", "rank").collect()
    for q in range(5):
        assert [r.vec_id for r in got if r.query_id == q] == [q + 5 * j for j in range(7)]
    score, ids = np.round(rng.standard_normal((6, 400)), 1), rng.permutation(400)
    best = retrieval.Best(6, 9)
    for a in range(0, 400, 13):  # whatever the tiles
        best.add(score[:, a : a + 13], ids[a : a + 13])
    at, near, _ = best.rows()
    for i in range(6):
        assert near[at == i].tolist() == ids[np.lexsort((ids, -score[i]))][:9].tolist()


def test_nearest_scores_one_large_cell_in_tiles():
    """What a task holds is bounded by queries, not by the rows of a cell; copies go by id."""
    r = np.random.default_rng(2)
    n, size, most = 10_000, 64, 20
    q, centres = nearest.unit(r.normal(size=(2048, size)).astype(np.float32)), nearest.unit(r.normal(size=(1, size)).astype(np.float32))
    v = nearest.unit(r.normal(size=(n, size)).astype(np.float32))
    v[r.random(n) < 0.3] = q[0]  # more copies of one vector than are kept
    placed = list(nearest._placed(centres)(iter([pa.RecordBatch.from_arrays([pa.array(r.permutation(n)), pa.array(v.tolist(), pa.list_(pa.float32()))], names=["id", "v"])])))[0]
    batch = placed.select(["cell", "id", "scale", "code"])
    tracemalloc.start()
    got = list(nearest.ranked_codes(iter([batch] * 3), q, np.zeros((2048, 1), np.int32), centres, most))[0].to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20, peak
    copies = sorted(batch.column("id").to_numpy()[(v == q[0]).all(axis=1)].tolist() * 3)
    assert got["id"][:most] == copies[:most] and len(got["id"]) == 2048 * most
