import random
import re

import numpy as np
import pytest

from docmill.llm import ngram_join as N
from docmill.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Component ids by union-find over all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted((repr(rows[i][0]), len(sets[i]), repr(rows[i][0] if not sets[i] else least[root(i)])) for i in range(len(rows)))


def got(df):
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in df.collect())


def test_odd_cases(docs, rows, empty):
    assert got(N.near_duplicates(docs)) == brute([(r[0], r[1]) for r in rows])
    assert N.near_duplicates(empty).count() == 0
    assert got(N.near_duplicates(docs.selectExpr("doc_id", "text", "1 AS id", "2 AS n", "3 AS key", "4 AS component"))) == got(N.near_duplicates(docs))


def chains(seed=1, groups=6, copies=14, length=60):
    """Groups of copies with growing edits, so that links form chains."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    rows, n = [], 0
    for _ in range(groups):
        text = [word() for _ in range(length)]
        for _ in range(copies):
            if r.random() < 0.8:
                text = [*text]
                for _ in range(r.randint(0, 3)):
                    text[r.randrange(len(text))] = word()
            if r.random() < 0.2:
                text = text[: r.randint(30, len(text))] + [word() for _ in range(r.randint(0, 20))]
            rows.append((n, " ".join(text)))
            n += 1
    r.shuffle(rows)
    return rows


def test_chains_equal_brute_force(spark):
    rows = chains()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(N.near_duplicates(df)) == brute(rows)


@pytest.mark.parametrize("limits", [{"cell_part": 5}, {"list_part": 9, "cell_part": 4, "hub_pairs": 3, "bucket_postings": 100}])
def test_hot_lists_in_a_grid(spark, limits):
    """Large groups of near copies, their lists, cells and hubs dealt out in small parts."""
    rows = chains(seed=3, groups=3, copies=45)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(N.near_duplicates(df, **limits)) == brute(rows)


def test_sketch_counts_all_sets(spark):
    """Every counter is the sum over all tasks, up to the step of its logarithm."""
    rows = [(i, "a b c d e" if i % 2 else f"one two three four five w{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    found = N.keyed(df, 16, counted=10)
    table = N.sketch(found, 16)
    want = np.zeros(1 << 16, np.int64)
    for _, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        want[(N.shingle_sets(data, np.array([0, len(data)]))[0] >> np.uint64(48)).astype(np.int64)] += 1
    got = N._COUNT_OF[table]
    assert (got >= want).all() and (got <= 1.1 * want + 1).all() and want.max() == 50
    assert found.where("slice IS NULL").count() == 100 and N.sketch_bits(0) == 16 and N.sketch_bits(1 << 60) == N.MOST_BITS


def test_equal_rolling_hashes_are_told_apart(spark):
    """Complementary Thue-Morse words share every polynomial hash modulo a power of two."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"x y z {word} q"), (4, f"x y z {other} q")]
    assert got(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_clashing_columns_and_one_of_each(spark, docs, rows):
    """One row of each class of linked texts, the one of the smallest id, its columns untouched; texts without a word all stay."""
    clash = docs.selectExpr("*", "'mine' AS key", "'mine' AS n", "'mine' AS component", "'mine' AS label")
    kept = N.one_of_each(clash)
    assert kept.columns == clash.columns and kept.where("key <> 'mine' OR n <> 'mine' OR component <> 'mine' OR label <> 'mine'").count() == 0
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    wordless = [r for r in rows if not shingles(r[1])]
    assert sorted(map(repr, (k for k in kept if not shingles(k[1])))) == sorted(repr((r[0], r[1])) for r in wordless)
    full = [(r[0], r[1]) for r in rows if shingles(r[1])]
    sets = [shingles(t) for _, t in full]
    up = list(range(len(full)))
    for i in range(len(full)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up = [up[i] if x == up[j] else x for x in up]
    want = [min((full[k] for k in range(len(full)) if up[k] == g), key=lambda x: (x[0] is None, x[0] or 0))[0] for g in set(up)]
    assert sorted(map(repr, (k[0] for k in kept if shingles(k[1])))) == sorted(map(repr, want))


def test_filters_are_safe():
    r = random.Random(2)
    for _ in range(300):
        universe = r.randint(10, 60)
        x = np.array(sorted(r.sample(range(universe), r.randint(5, universe - 1))))
        y = np.array(sorted(r.sample(range(universe), r.randint(5, universe - 1))))
        both = len(set(x) & set(y))
        assert N.suffix_filter(x, y, both)
        if 5 * both >= 4 * len(set(x) | set(y)):
            assert both >= N.least_overlap(len(x), len(y))
            assert set(x[: N.prefix_length(len(x))]) & set(y[: N.prefix_length(len(y))])


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (205, 200), (200, 203)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(out[i] == 0 for i in range(31)) and out[101] == 100 and out[205] == out[203] == 200
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
