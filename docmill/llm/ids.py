"""Token ids of whole texts, a worker's cache of pieces in front of the library.

The pattern of a byte-level BPE splits a text into letters, digits, marks and white space, a space going
with what follows.  Most of its splits are told by two or three neighbouring bytes: texts are cut there by
numpy, all bytes of a batch at once, and where a split isn't certain (an apostrophe before a letter, white
space before an unknown character, letters beyond Latin and Cyrillic) the piece stays whole for the
library.  The ids of a text are those of its pieces, one after another, and pieces repeat: each worker
keeps the ids of the pieces it has met (CACHE_PIECES at most; then the rarer ones go) in one flat array, so
the ids of a batch of texts are one gather.  Where a tokenizer's file tells of another kind, whole texts go
to the library.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PIECES = 3 << 18
#: Pieces that go to the library as one text, and longer ones that aren't cached.
JOINED, CACHED_CHARS = 256, 256
#: Letters of two bytes: U+00C0 to U+027F without two signs, and U+0400 to U+047F.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u027f\u0400-\u047f", r"!-/:-@\[-`{-~"
#: Pieces that the byte-level pattern leaves whole.
_WHOLE = re.compile(f" ?(?:[{_LETTERS}]+|[0-9]+|[{_MARKS}]+)|\n")
#: Kinds of bytes.  MAYBE: white space or not; OTHER: no white space; later bytes of a character have its first one's kind.
MAYBE, LETTER, DIGIT, MARK, APOSTROPHE, OTHER, SPACE, LINE = range(8)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte; whether the pattern splits between two kinds, whatever is around them."""
    kind = np.full(256, OTHER, np.uint8)
    kind[:0x80] = MAYBE  # control characters
    kind[0x21:0x7F] = MARK
    for first, last in ("AZ", "az"):
        kind[ord(first) : ord(last) + 1] = LETTER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[[ord("'"), ord(" "), ord("\n")]] = APOSTROPHE, SPACE, LINE
    kind[0x80:0xC0] = LETTER  # behind the letters that follow; put right where others occur
    kind[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = LETTER
    kind[[0xC2, 0xE1, 0xE2, 0xE3]] = MAYBE
    splits = np.zeros((8, 8), bool)
    splits[LETTER : OTHER + 1, SPACE:] = True
    for a in (LETTER, DIGIT, MARK, APOSTROPHE):
        splits[a, LETTER : APOSTROPHE + 1] = True
        splits[a, a] = False
    splits[MARK, APOSTROPHE] = splits[APOSTROPHE, MARK] = splits[APOSTROPHE, LETTER] = False
    return kind, splits.ravel()


_KIND, _SPLITS = _kinds()


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 texts, one after another, begin a piece whose ids don't depend on what is around it; ends: of texts that aren't empty."""
    kind = _KIND[data]
    signs = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    if signs.any():
        kind[:-1][signs] = OTHER
    if ((kind == OTHER) | ((kind == MAYBE) & (data >= 0x80))).any():
        later = np.flatnonzero((data & 0xC0) == 0x80)
        for _ in range(3):
            kind[later] = kind[later - 1]
    begins = np.empty(len(data), bool)
    begins[1:] = _SPLITS[kind[:-1] << 3 | kind[1:]]
    # The last white space before something else: a space goes with it, a line end is alone.
    before = np.empty(len(data), bool)
    before[:-1] = (kind[1:] >= LETTER) & (kind[1:] <= OTHER)
    before[ends - 1] = False
    before &= kind >= SPACE
    begins |= before
    begins[1:] |= before[:-1] & (kind[:-1] == LINE)
    begins[0] = True
    begins[ends[:-1]] = True
    return begins


def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for what follows from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles inside: what is made there has none, and walking lists of ids took two fifths of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Library:
    """A tokenizer's ids and bytes of texts.

    cuts: whether ids of a text are those of its parts, cut before a space that a non-space follows.
    """

    cuts = False
    #: Special strings that the library takes as one token, by pattern; None where there are none.
    special: re.Pattern | None = None

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        raise NotImplementedError

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id."""
        raise NotImplementedError


class TokenizersFile(Library):
    """A file of the tokenizers library.  plain: special strings inside texts are ordinary text."""

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:  # the tokenizer's own file, installed on every machine
            told = json.load(f)
        cut = told.get("pre_tokenizer") or {}
        added = told.get("added_tokens", [])
        exact = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
        self.cuts = told.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and exact and told["model"]["type"] == "BPE"
        if added and not plain:
            self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))))
        self.added = {t["content"]: t["id"] for t in added}
        self.model = self.library.model
        alphabet = _alphabet()
        self.shown = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(0x480)}

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, pieces: Sequence[str]) -> list[list[int] | None]:
        """Ids of each piece, by the library's model alone, None for pieces that its pattern may split."""
        tokens, whole, shown = self.model.tokenize, _WHOLE.fullmatch, self.shown
        out: list[list[int] | None] = []
        for p in pieces:
            if p.isascii() and (word := p[1:] if p[0] == " " else p).isalpha():
                out.append([t.id for t in tokens(p if word is p else "Ġ" + word)])
            elif whole(p):
                out.append([t.id for t in tokens(p.translate(shown))])
            else:
                out.append(None)
        return out

    def token_bytes(self) -> list[bytes]:
        byte = {c: b for b, c in _alphabet().items()}
        out = [b""] * self.library.get_vocab_size(with_added_tokens=True)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            out[i] = token.encode() if token in self.added else bytes(byte[c] for c in token)
        return out


class SentencePieceFile(Library):
    """A model file of sentencepiece, which puts a space before every text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.library.id_to_piece(i) for i in range(len(self.library))]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self.library.encode(list(texts), num_threads=1)

    def token_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]

    def altered(self) -> set[str] | None:
        """The characters that its ids don't give back; None where texts may be altered in other ways, or merges pass a space behind a non-space."""
        if any("▁" in p.lstrip("▁") for p in self.pieces) or not all(self.library.piece_to_id(f"<0x{b:02X}>") != self.library.unk_id() for b in range(256)):
            return None
        out: set[str] = set()
        every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 0x20]
        for at in range(0, len(every), 1 << 14):
            some = every[at : at + (1 << 14)]
            if self.library.normalize("".join(some)) == "▁" + "".join(some) and "▁" not in some:
                continue
            out |= {c for c in some if c == "▁" or self.library.normalize(c) != "▁" + c}
        return out if len(out) < 1000 and self.library.normalize("a  b ") == "▁a▁▁b▁" else None


class Cache:
    """Ids of texts by a library."""

    def __init__(self, library: Library, size: int = CACHE_PIECES) -> None:
        self.library, self.size = library, size
        #: Ids that begin with a space show where joined pieces begin.
        self.opens = np.array([b.startswith(b" ") for b in library.token_bytes()]) if library.cuts else None
        self.clear()

    def clear(self) -> None:
        # By piece; an id behind every text by itself.
        self.index: dict[str | int, int] = {}
        self.flat, self.starts, self.counts, self.hits = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.have = 0

    def _kept(self, keys: list, flat: np.ndarray, counts: np.ndarray) -> None:
        have, more = self.have, len(flat)
        while have + len(keys) > len(self.starts):
            self.starts, self.counts, self.hits = (np.append(x, np.zeros_like(x)) for x in (self.starts, self.counts, self.hits))
        while self.used + more > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.starts[have : have + len(keys)] = self.used + np.cumsum(counts) - counts
        self.counts[have : have + len(keys)] = counts
        self.hits[have : have + len(keys)] = 0
        self.flat[self.used : self.used + more] = flat
        self.used, self.have = self.used + more, have + len(keys)
        self.index.update(zip(keys, range(have, have + len(keys)), strict=True))

    def _thin(self) -> None:
        """Leaves the pieces met most often, a third of `size` at most and none met once."""
        if self.size < 3:
            return self.clear()
        hits = self.hits[: self.have]
        floor = max(2, int(np.partition(hits, -(self.size // 3))[-(self.size // 3)]) + 1) if self.have > self.size // 3 else 2
        old = [k for k, i in self.index.items() if hits[i] >= floor]
        at = np.array([self.index[k] for k in old], np.int64)
        counts, hits = self.counts[at], hits[at]
        flat = self.flat[np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
        self.clear()
        self._kept(old, flat, counts)
        self.hits[: self.have] = hits // 2

    def _encode(self, pieces: list[str]) -> None:
        """Keeps the ids of pieces: what the model can't take is joined where each has one space, in front, the rest goes one by one."""
        flat, sizes, done, alone = [], [], [], pieces
        if isinstance(self.library, TokenizersFile) and self.library.cuts:
            got = self.library.words(pieces)
            done = [p for p, ids in zip(pieces, got, strict=True) if ids]
            alone = [p for p, ids in zip(pieces, got, strict=True) if not ids] if len(done) < len(pieces) else []
            known = [ids for ids in got if ids]
            sizes.append(np.fromiter(map(len, known), np.int64, len(known)))
            flat.append(np.fromiter(chain.from_iterable(known), np.int32, int(sizes[0].sum())))
        together = [p for p in alone if p[0] == " " and len(p) > 1 and " " not in p[1:]] if self.opens is not None else []
        if together:
            alone = list(set(alone).difference(together))
        for at in range(0, len(together), JOINED):
            some = together[at : at + JOINED]
            ids = np.array(self.library.encode(["".join(some)])[0], np.int32)
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) != len(some) or begins[0]:  # a library that joins what it should not
                alone = alone + some
                continue
            flat.append(ids)
            sizes.append(np.diff(begins, append=len(ids)))
            done += some
        for at in range(0, len(alone), 4096):
            some = alone[at : at + 4096]
            got = self.library.encode(some)
            flat += [np.array(x, np.int32) for x in got]
            sizes.append(np.array([len(x) for x in got], np.int64))
            done += some
        if done:
            self._kept(done, np.concatenate(flat), np.concatenate(sizes))

    def _pieces(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, one after another, and how many each text has."""
        special = self.library.special
        if special is not None and (held := self._special(column)).any():
            # Special strings are pieces; texts are cut around them.
            parts, each, apart = [], np.ones(len(column), np.int64), []
            for k, (text, has) in enumerate(zip(column.to_pylist(), held.tolist(), strict=True)):
                own = [x for pair in zip(special.split(text), [*special.findall(text), ""], strict=True) for x in pair] if has else [text]
                apart += [has and i % 2 == 1 for i in range(len(own))]
                parts += own
                each[k] = len(own)
            pieces, counts = self._cut(pa.array(parts, pa.large_string()), np.array(apart))
            return pieces, np.add.reduceat(counts, np.cumsum(each) - each)
        return self._cut(column)

    def _special(self, column: pa.Array) -> np.ndarray:
        held = np.zeros(len(column), bool)
        for s in self.library.added:
            held |= pc.match_substring(column, s).to_numpy(zero_copy_only=False).astype(bool)
        return held

    def _cut(self, column: pa.Array, apart: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
        """Pieces and their number in each text; texts that are `apart` stay whole."""
        _, offsets, data = column.buffers()
        edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        if edges[0] == edges[-1]:
            return pa.array([], pa.large_string()), np.zeros(len(column), np.int64)
        raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
        own = edges - edges[0]
        filled = own[1:] > own[:-1]
        if self.library.cuts:
            begins = cuts(raw, own[1:][filled])
            for k in np.flatnonzero(apart & filled).tolist() if apart is not None else ():
                begins[own[k] + 1 : own[k + 1]] = False
            starts = np.flatnonzero(begins)
        else:
            starts = own[:-1][filled]
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts + edges[0], edges[-1])), data)
        return pieces, np.diff(np.searchsorted(starts, own))

    @uncollected()
    def ids(self, texts: Sequence[str] | pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, `end` behind each where given, and the bounds of each text's."""
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        pieces, counts = self._pieces(column)
        # Each distinct piece is looked up once.
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy()
        keys: list[str] = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = self._looked_up(keys)
        missed = np.flatnonzero(places < 0).tolist()
        if len(self.index) + len(missed) > self.size and len(self.index) > 1:
            self._thin()
            places = self._looked_up(keys)
            missed = np.flatnonzero(places < 0).tolist()
        if end is not None and end not in self.index:
            self._kept([end], np.array([end]), np.array([1]))
        fresh = [keys[i] for i in missed]
        long = [k for k in fresh if len(k) > CACHED_CHARS]
        if short := [k for k in fresh if len(k) <= CACHED_CHARS] if long else fresh:
            self._encode(short)
        before = self.used, self.have
        if long:
            self._encode(long)
        places[missed] = [self.index[k] for k in fresh]
        # Distinct pieces' ids, then those of every piece by a gather.
        self.hits[places] += np.bincount(which, minlength=len(keys))
        starts, sizes = self.starts[places], self.counts[places]
        if end is not None:
            which = np.insert(which, np.cumsum(counts), len(keys))
            counts = counts + 1
            starts, sizes = np.append(starts, self.starts[self.index[end]]), np.append(sizes, 1)
        n = sizes[which]
        ids = self.flat[ranges(starts[which], n)]
        bounds = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(counts))].astype(np.int64)
        if long:  # used once, not kept
            self.used, self.have = before
            for k in long:
                del self.index[k]
        return ids, bounds

    def _looked_up(self, keys: list[str]) -> np.ndarray:
        """Where each of keys is kept, -1 where it isn't."""
        return np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of ranges, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


_WORKER: dict[tuple, Cache] = {}


def worker(key: tuple, made: Callable[[], Cache]) -> Cache:
    """This Python worker's cache under key, kept from task to task."""
    if key not in _WORKER:
        _WORKER[key] = made()
    return _WORKER[key]
