import random
import re

from docmill.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item) if item is not None else "null")
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    items |= found
        out.append((repr(doc), len(w), len(hit), tuple(sorted(items)), bool(hit)))
    return sorted(out)


def got(df):
    return sorted((repr(r.doc_id), r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in df.collect())


def test_random_texts(spark):
    r = random.Random(1)
    word = lambda: r.choice("ab cd ef gh Ij kl".split())
    text = lambda n: " ".join(word() for _ in range(n))
    bench = [(i, text(r.choice([0, 1, 2, 3, 5, 9, 10, 11, 25]))) for i in range(25) if i % 6] + [(None, "only null id " * 4), (3, "a second text of item three with more than ten words in it"), (77, None)]
    docs = [(i, text(r.randint(0, 60))) for i in range(60)] + [(100 + i, f"{text(5)} {b[1]} {text(4)}") for i, b in enumerate(bench)] + [(500, None), (501, "")]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert got(D.matched(df.repartition(3), b)) == brute(docs, bench)
    assert got(D.matched(df, b, slice_bytes=200)) == brute(docs, bench)


def test_one_word_items_and_places(spark):
    bench = [(1, "Alpha"), (2, "one two three four five six seven eight nine ten eleven")]
    docs = [(1, "say alpha, ALPHA!"), (2, "x one two three four five six seven eight nine ten eleven y"), (3, "one two three four five six seven eight nine")]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    out = {r.doc_id: r for r in D.matched(df, b).collect()}
    assert got(D.matched(df, b)) == brute(docs, bench)
    assert [tuple(m) for m in out[2].matches] == [(1, 11, "2", 0)] and out[3].matches == []


def test_matches_are_verbatim(spark):
    """Windows that touch in the text but not in the item are two matches; each names where it stands in the item."""
    w = [f"w{i}" for i in range(20)]
    bench = [(1, " ".join(w)), (2, " ".join(w[5:]))]
    docs = [(1, " ".join([*w[10:], *w[:10]])), (2, " ".join(["x", *w[5:18], "y"])), (3, " ".join(w[:9])), (4, " ".join([*w[:12], *w[3:15]]))]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    out = {r.doc_id: [tuple(m) for m in r.matches] for r in D.matched(df, b).collect()}
    assert out == {1: [(0, 10, "1", 10), (10, 10, "1", 0)], 2: [(1, 13, "1", 5)], 3: [], 4: [(0, 12, "1", 0), (12, 12, "1", 3)]}
    assert got(D.matched(df, b)) == brute(docs, bench)


def test_longest_matches_against_brute_force(spark):
    r = random.Random(8)
    text = lambda n: [r.choice("ab cd ef".split()) for _ in range(n)]
    bench = [(i, " ".join(text(r.randint(8, 30)))) for i in range(12)]
    docs = [(i, " ".join(text(80))) for i in range(15)]
    df, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(bench, "item_id long, text string")
    for row in D.matched(df, b).collect():
        w = words(row.text)
        longest = {}
        for s in range(len(w)):
            for _, t in bench:
                v = words(t)
                for p in range(len(v)):
                    n = next((k for k in range(min(len(v) - p, len(w) - s)) if v[p + k] != w[s + k]), min(len(v) - p, len(w) - s))
                    if n >= 10 or (len(v) < 10 and n == len(v)):
                        longest[s] = max(longest.get(s, 0), n)
        want, reach = [], 0
        for s, n in sorted(longest.items()):
            if s + n > reach:
                want.append((s, n))
                reach = s + n
        assert [(m.first_word, m.n_words) for m in row.matches] == want
        for m in row.matches:
            v = words(dict(bench)[int(m.item_id)])
            assert v[m.item_word : m.item_word + m.n_words] == w[m.first_word : m.first_word + m.n_words]


def test_one_window_in_thousands_of_items(spark):
    """A hot passage: one match in the row, all items by id."""
    passage = " ".join(f"p{i}" for i in range(12))
    bench = [(i, f"{passage} own{i} tail{i}") for i in range(2000)]
    docs = [(i, f"start{i} {passage} end{i}") for i in range(300)]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    rows = D.matched(df, b).collect()
    assert all([tuple(m) for m in r.matches] == [(1, 12, "0", 0)] and len(r["items"]) == 2000 and r.n_hit == 12 for r in rows)


def test_odd_cases(spark, docs, rows, empty):
    bench = spark.createDataFrame([(1, rows[0][1][:200]), (2, None), (3, "")], "item_id long, text string")
    out = D.matched(docs.selectExpr("*", "'mine' AS n_hit", "'mine' AS other"), bench)
    assert got(out) == brute([(r[0], r[1]) for r in rows], [(1, rows[0][1][:200])])
    assert out.where("other <> 'mine'").count() == 0
    assert D.matched(empty, bench).count() == 0
    none = D.matched(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)


def test_bounded_on_repeated_words_and_long_items(monkeypatch):
    """One word 500,000 times against 1,000 times, and an item of 50,000 words whole in a text."""
    import time
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    def run(texts, bench):
        test = D.TestSet([str(i) for i in range(len(bench))], pa.array(bench))
        m = D.Matcher(test)
        raw = [t.encode() for t in texts]
        m.add(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        m.flush()
        return m

    tracemalloc.start()
    began = time.process_time()
    m = run(["0 " * 500_000], ["0 " * 1000])
    assert len(m.matches[0]) == 499_001 and m.matches[0][7] == {"first_word": 7, "n_words": 1000, "item_id": "0", "item_word": 0}
    assert tracemalloc.get_traced_memory()[1] < 1 << 30 and time.process_time() - began < 120
    tracemalloc.stop()
    r = random.Random(4)
    item = " ".join(f"w{r.randint(0, 5000)}" for _ in range(50_000))
    began = time.process_time()
    m = run([f"a b {item} c", "x"], ["other words here", item])
    assert m.matches == [[{"first_word": 2, "n_words": 50_000, "item_id": "1", "item_word": 0}], []] and time.process_time() - began < 10


def test_small_shards_give_the_same(spark, monkeypatch):
    r = random.Random(11)
    text = lambda n: " ".join(r.choice("ab cd".split()) for _ in range(n))
    bench = [(i, text(r.choice([2, 9, 10, 15, 40]))) for i in range(12)]
    docs = [(i, text(r.randint(0, 120))) for i in range(60)]
    df, b = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(bench, "item_id long, text string")
    at_once = sorted(map(repr, D.matched(df, b).collect()))
    monkeypatch.setattr(D, "SHARD_WORDS", 50)
    monkeypatch.setattr(D.A, "BLOCK_BYTES", 300)
    assert sorted(map(repr, D.matched(df, b).collect())) == at_once
