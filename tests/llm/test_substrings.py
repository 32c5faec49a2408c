import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.llm import substrings as S
from docmill.llm.suffixes import common_prefixes, suffix_array


def brute(rows, length):
    """rows: distinct (id, text), in order."""
    seen, out = set(), {}
    for doc, text in rows:
        b = (text or "").encode()
        flags = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                flags[i : i + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for i in range(len(b)) if flags[i] and (i == 0 or not flags[i - 1]))
        out[doc] = (len(b), sum(flags), runs, hashlib.sha256(bytes(x for x, f in zip(b, flags, strict=True) if not f)).hexdigest())
    return out


def digest(df):
    return {r.doc_id: (r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\0", min_size=1, max_size=30), min_size=1, max_size=6))
def test_suffix_array_and_common_prefixes(strings):
    raw = [s.encode() for s in strings]
    text = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.cumsum([0, *map(len, raw)])
    suffixes = [(raw[k][i:], k, bounds[k] + i) for k in range(len(raw)) for i in range(len(raw[k]))]
    want = [p for *_, p in sorted(suffixes, key=lambda x: [*[c + len(raw) for c in x[0]], x[1]])]
    order = suffix_array(text, bounds)
    assert order.tolist() == want
    by_place = {p: s for s, _, p in suffixes}
    shared = common_prefixes(text, bounds, order).tolist()
    for k in range(1, len(want)):
        a, b = by_place[want[k - 1]], by_place[want[k]]
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def corpus(seed, n, copies=0.6):
    r = random.Random(seed)
    pool = ["".join(r.choices("abcde \n", k=r.randint(30, 200))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [r.choice(pool) if r.random() < copies else "".join(r.choices("abcdeé ", k=r.randint(0, 90))) for _ in range(r.randint(0, 5))]
        rows.append((i * 3, "".join(parts)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 600}, {"shard_bytes": 600, "hot_in_block": 1, "hot_segments": 2}, {"hot_segments": 0}])
def test_equal_to_brute_force(spark, limits):
    rows = corpus(4, 60) + [(1000, "z" * 400), (1001, "ab" * 150), (1002, None), (1003, "")]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string").repartition(4)
    assert digest(S.deduplicated(df, length=40, **limits)) == brute(rows, 40)


@pytest.mark.parametrize("hot", [(1, 4096), (16, 10), (16, 4096)])
def test_one_anchor_over_many_shards(spark, hot):
    """A passage followed by a different text in every document: its last segments differ, their anchor is one."""
    r = random.Random(9)
    passage = "".join(r.choices("abcdefgh", k=80))
    rows = [(i, passage + "".join(r.choices("ij", k=40))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert digest(S.deduplicated(df, length=60, shard_bytes=300, hot_in_block=hot[0], hot_segments=hot[1])) == brute(rows, 60)


def test_segments_of_a_hot_anchor_leave_for_many_shards(spark):
    """No task reads them all: they carry a salt by content, and the shards' runs meet by digest."""
    r = random.Random(9)
    passage = "".join(r.choices("abcdefgh", k=80))
    rows = [(i, 0, passage + "".join(r.choices("ij", k=40))) for i in range(150)]
    docs = spark.createDataFrame(rows, f"{S.ID} long, {S.H} int, {S.TEXT} string").repartition(3)
    marks = S.anchors(docs, 8, 60, 4).groupBy("bucket").applyInArrow(lambda group: S.repeats(group), S._MARKS)
    cut = S.cut_out(docs, marks.where("octet_length(asked) > 0").groupBy(S.ID, S.H).agg(F.collect_list("asked").alias("marks")), 60)
    hot = cut.where("salt >= 0")
    assert hot.select("key").distinct().count() < hot.select("key", "salt").distinct().count()
    assert S.sorted_shards(cut, 60, 8, 300).where("bucket IS NOT NULL").select("bucket").distinct().count() > 1


def test_equal_rolling_hashes_are_told_apart(spark):
    """Complementary Thue-Morse words have one polynomial hash modulo a power of two; they aren't the same string."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]
    for length in (100, 1024):
        assert digest(S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), length=length)) == brute(rows, length)


def test_odd_cases(spark, docs, rows, empty):
    """Every row, those of a null id and of one id with two texts included; ids repeat, so results are held by id and text."""
    out = S.deduplicated(docs.selectExpr("*", "'mine' AS start", "'mine' AS anchor", "1 AS marks"))
    assert out.count() == len(rows) and out.where("start <> 'mine' OR anchor <> 'mine' OR marks <> 1").count() == 0
    tie = {t: h for t, h in spark.createDataFrame([(r[1],) for r in rows if r[1]], "text string").select("text", F.hash("text")).collect()}
    unique = sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, tie.get(x[1], 42)))
    want = brute([(x, x[1]) for x in unique], S.LENGTH)
    got = {((r.doc_id, r.text), r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()}
    assert got == {(x, *want[x]) for x in unique}
    assert S.deduplicated(empty).count() == 0
