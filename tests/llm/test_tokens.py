import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docmill.llm import tokens as K

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counts():
    return K.Counts(PATH, K.Table.of({" the": 1, "the": 1}))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab Z9'é  \n\t\r\x1c\x85\xa0　!<|endoftext>", max_size=40), max_size=5))
def test_counts_equal_the_library(texts):
    got = K.Counts(PATH, K.Table.of({" a": 1})).of(texts) if not hasattr(test_counts_equal_the_library, "c") else test_counts_equal_the_library.c.of(texts)
    assert got == [len(e) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


test_counts_equal_the_library.c = K.Counts(PATH, K.Table.of({" a": 1}))


def test_pieces_are_the_text():
    for t in ("a  b c", " x", "x ", "\n\n a", "", "   ", "a \n b"):
        assert "".join(K.pieces(t)) == t


def test_special_strings(counts):
    texts = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x <|endoftext|> y"]
    assert counts.of(texts) == [len(e) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_small_caches_give_the_same(monkeypatch):
    monkeypatch.setattr(K, "CACHE_PIECES", 3)
    monkeypatch.setattr(K, "ENCODED", 2)
    texts = ["some words in a text that is longer than the cache", "words again in another text"]
    assert K.Counts(PATH, K.Table.of({})).of(texts) == [len(e) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_table(docs, rows, empty):
    got = {(r.doc_id, r.text): (r.n_bytes, r.n_tokens, r.over_limit) for r in K.counted(docs, PATH).collect()}
    for r in rows:
        n = len(LIBRARY.encode(r[1] or "", add_special_tokens=False))
        assert got[r[0], r[1]] == (len((r[1] or "").encode()), n, n > 512)
    assert K.counted(empty, PATH).count() == 0
    clash = K.counted(docs.selectExpr("doc_id", "text AS n_tokens"), PATH, text="n_tokens")
    assert clash.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and clash.count() == len(rows)
