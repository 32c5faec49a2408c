import re

import numpy as np

from docmill.llm import arrays as A
from docmill.llm import quality as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {w for w in wins if wins.count(w) > 1} if len(wins) < 3000 else {w for w, n in __import__("collections").Counter(wins).items() if n > 1}
    inside = {i + k for i, w in enumerate(wins) if w in seen for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside), "n_letters": len(re.findall("[A-Za-z]", text)), "n_upper": len(re.findall("[A-Z]", text)),
    }


def test_measures_equal_a_plain_version(docs, rows):
    got = sorted((repr((r.doc_id, r.text)), *[r[m] for m in Q.MEASURES]) for r in Q.measured(docs).collect())
    assert got == sorted((repr((r[0], r[1])), *plain(r[1]).values()) for r in rows) or [dict(zip(Q.MEASURES, g[1:], strict=True)) for g in got] == [plain(t) for _, t in sorted((repr((r[0], r[1])), r[1]) for r in rows)]


def test_policies_and_ablation(docs):
    book = Q.ledger(docs)
    kept = book.where(Q.passes(Q.CURRENT)).count()
    assert kept == book.where("fail_bits = 0").count() > 0
    assert book.where(Q.passes(Q.BASE)).count() >= kept
    table = {r.rule: r for r in Q.ablation(book, Q.CURRENT).collect()}
    assert set(table) == {r.name for r in Q.RULES}
    for k, rule in enumerate(Q.RULES):
        assert table[rule.name].n_failed == book.where(f"fail_bits & {1 << k} <> 0").count()
        assert table[rule.name].n_failed_alone == book.where(f"fail_bits = {1 << k}").count()


def test_empty_table_and_clashing_columns(spark, docs, empty):
    assert Q.ledger(empty).count() == 0
    clash = docs.selectExpr("*", "'mine' AS n_words", "'mine' AS fail_bits")
    out = Q.ledger(clash, prefix="__q_")
    assert out.where("n_words <> 'mine' OR fail_bits <> 'mine'").count() == 0
    assert out.where("__q_n_words IS NULL").count() == 0
    assert Q.ledger(clash).schema["n_words"].dataType.simpleString() == "bigint"


def test_labelled_junk_goes_and_the_rest_stays(spark):
    """Recall on documents labelled as junk, and what the rules beyond the base take of the others."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality").distinct()
    book = Q.ledger(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id")
    judged = book.select("quality", Q.passes(Q.CURRENT).alias("kept"), Q.passes(Q.BASE).alias("base")).collect()
    junk, good = [r for r in judged if not r.quality], [r for r in judged if r.quality]
    assert len(junk) > 20 and sum(not r.kept for r in junk) >= 0.98 * len(junk)
    assert len(good) > 100 and sum(r.base and not r.kept for r in good) <= 0.005 * len(good)


def test_equal_rolling_hashes_are_told_apart():
    """Complementary Thue-Morse lines share every polynomial hash modulo a power of two; neither repeats the other."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for text in (f"{word}\n{other}", f"{word} x y {other} x y", f"{word}\n{word}"):
        data = np.frombuffer(text.encode(), np.uint8)
        got = Q.measure_block(data, np.array([0, len(data)]))
        assert {m: int(got[m][0]) for m in Q.MEASURES} == plain(text)


def test_string_hash_takes_every_byte():
    texts = [b"", b"a", b"a\0", b"\0a", b"abcdefgh", b"abcdefghi", b"abcdefgh\0", b"x" * 64, b"x" * 65, b"x" * 64 + b"y", b"x" * 200]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    assert len(set(A.string_hash(data, ends - [len(t) for t in texts], ends).tolist())) == len(texts)


def test_kernels():
    data = np.frombuffer("ab ab ab cd".encode(), np.uint8)
    w = A.Words(data, np.array([0, 5, len(data)]), A.SPACED, lower=True)
    assert w.counts.tolist() == [2, 2]
    assert w.hashes[0] == w.hashes[1] == w.hashes[2] != w.hashes[3]
    assert A.covered(np.array([1, 2]), 2, 5).tolist() == [False, True, True, True, False]
    assert A.repeated(np.array([3, 1, 3], np.uint64)).tolist() == [True, False, True]
