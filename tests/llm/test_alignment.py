import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docmill.llm import alignment as L
from docmill.llm import ids as I

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ONE = Tokenizer.from_file(A)
ONE.encode_special_tokens = True
TWO = sentencepiece.SentencePieceProcessor(model_file=B)
A_BYTES, B_BYTES = I.TokenizersFile(A, plain=True).token_bytes(), I.SentencePieceFile(B).token_bytes()


def groups(text):
    """Groups of one text by two running ends, None where it has no tokens."""
    a, b = (ONE.encode(" " + text, add_special_tokens=False).ids, TWO.encode(text)) if text else ([], [])
    if not text or b"".join(A_BYTES[i] for i in a) != (" " + text).encode() or b"".join(B_BYTES[i] for i in b) != (" " + text).encode():
        return None
    out, i, j = [], 0, 0
    while i < len(a):
        left, right, x, y = [a[i]], [b[j]], len(A_BYTES[a[i]]), len(B_BYTES[b[j]])
        i, j = i + 1, j + 1
        while x != y:
            if x < y:
                left.append(a[i])
                x += len(A_BYTES[a[i]])
                i += 1
            else:
                right.append(b[j])
                y += len(B_BYTES[b[j]])
                j += 1
        out.append((left, right))
    return out


def brute(rows):
    found = [(d, groups(t)) for d, t in rows]
    counts = Counter((x[-1], y[-1]) for _, g in found for x, y in g or ())
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for d, g in found:
        g = g or []
        links = [(x[-1], y[-1]) for x, y in g]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((repr(d), sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(g), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), text))
    return sorted(out), counts


@pytest.fixture(params=["align", "relational"])
def form(request, spark):
    f = getattr(L, request.param)

    def run(rows, block_bytes=2_000):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        return f(df, L.byte_level(A), L.sentence_piece(B), **({"block_bytes": block_bytes} if request.param == "relational" else {}))

    return run


def check(form, rows, **kw):
    found = form(rows, **kw)
    want, counts = brute(rows)
    assert sorted((repr(r[0]), *r[1:]) for r in found.documents.collect()) == want
    assert {(r.a, r.b): r["count"] for r in found.pairs.collect()} == dict(counts)


def test_equals_brute_force(form, rows):
    r = random.Random(2)
    letters = "ab Z9'é  \n\t\r\x1c\x85\xa0　!<|endoftext>▁.😀́ﬁÅ"
    odd = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(400)]
    more = ["<|endoftext|>", "<s> a </s>", "<0x41>", "a\x00b", " ", "  ", "\n", "▁", "x" * 3000, "a ▁b", "don't  stop\n\n now"]
    check(form, [(r_[0], r_[1]) for r_ in rows] + [(1000 + i, t) for i, t in enumerate(odd + more)], block_bytes=30_000)


def test_hot_text_and_hot_word(form):
    rows = [(i, "the same text for a third of all rows") for i in range(300)] + [(i, f"the the the the {i}") for i in range(300, 900)]
    check(form, rows, block_bytes=2_000)


def test_pairs_beyond_the_broadcast(form, rows, monkeypatch):
    monkeypatch.setattr(L, "SENT_PAIRS", 0)
    check(form, [(r[0], r[1]) for r in rows[:12]])


def test_tokenizers_that_cut_otherwise(form, rows, monkeypatch):
    """A whole text is then a piece, and those whose tokens alter it have none."""
    monkeypatch.setattr(I.SentencePieceFile, "altered", lambda self: None)
    check(form, [(r[0], r[1]) for r in rows] + [(50, "a▁b"), (51, "a b")])


def test_small_tables_and_long_pieces(monkeypatch):
    r = random.Random(6)
    texts = [" ".join("".join(r.choices("abcé.", k=r.randint(1, 6))) for _ in range(r.randint(0, 30))) for _ in range(200)] + ["x" * 200 + " y", None, "", "a▁b c", "▁"]
    monkeypatch.setattr(L, "LONG_PIECE", 100)
    table = L.Pieces(L.byte_level(A), L.sentence_piece(B), L.CUT, size=30)
    for at in range(0, len(texts), 7):
        some = texts[at : at + 7]
        numbers, said, links, bounds = table.of(some)
        for i, t in enumerate(some):
            g = groups(t) or []
            assert numbers[:, i].tolist() == [sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g)]
            assert said[i] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            assert list(zip(*links[:, bounds[i] : bounds[i + 1]].tolist(), strict=True)) == [(x[-1], y[-1]) for x, y in g]


def test_altered_characters():
    assert I.SentencePieceFile(B).altered() == {"▁"}


def test_odd_cases(spark, docs, empty):
    found = L.align(empty, L.byte_level(A), L.sentence_piece(B))
    assert found.documents.count() == 0 and found.pairs.count() == 0
    clash = L.align(docs.selectExpr("doc_id AS n_a", "text AS groups", "1 AS block", "2 AS doc_id"), L.byte_level(A), L.sentence_piece(B), row_id="n_a", text="groups")
    assert clash.documents.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("name", list(L._CONF))
def test_settings_are_put_back(spark, name):
    assert spark.conf.get(name) != L._CONF[name]
