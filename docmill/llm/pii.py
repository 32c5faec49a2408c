"""Personal data replaced by keyed, type-consistent surrogates.

Found entities: e-mail addresses, phone numbers, payment cards (with a right check digit), IPv4
addresses, social security numbers, IBANs (with right check digits) and names of persons.  The
surrogate of an entity is its image under a keyed permutation of all values of the same kind and
shape: digits stay digits, vowels vowels, a script its script, check digits are made anew, a given
name goes to one of the same gender and script.  A permutation keeps distinct values distinct and
gives a value the same surrogate in every document, without any shared state.

Names of persons are those that the lists GIVEN (some 145 names in Latin, Cyrillic and Greek script)
and TITLES give away: a listed given name before a capitalized surname (up to two initials and PARTICLES between,
capitals throughout allowed; a second listed name takes one more word), a title before capitalized words (all of
them up to four, particles and initials between), or a phrase of INTRODUCTIONS before two or
three capitalized words, whatever they are.  Other capitalized mentions of the given
names and surnames so found in a text are replaced with them, hyphenated surnames also by part (a
part has a surrogate of its own); surnames that are FUNCTION_WORDS aren't followed.  Persons of other
given names without a title or an introduction, and names in scripts without capitals, stay.

Phones without '+' or a bracketed area code are those of three, three and four digits, also behind
a trunk 1; 555-1234; groups behind a trunk 0, nine to eleven digits; and other groups of two to four
digits, nine or ten in all.  Left on purpose: what reads as a date, as years, a version or a number
in thousands; digits in one group; pairs that don't start with 0; seven digits without a dash.

The collision check covers the whole corpus, given names apart, whose surrogates are always listed
names: a surrogate that is itself an original somewhere would be mistaken for that person.
Where nearly all values of a shape are originals, so that IDLE_ROUNDS rounds settle none, those
left keep their first surrogate, which is still their own: no other value has it.  Distinct originals are joined with the surrogates; those that
clash get their image under another permutation, unless that clashes with an original or a
surrogate given before, and so on.  The few values so changed go to the tasks in slices of
MAX_SENT, one pass each.

Defined cases: null and empty texts stay as they are, with no entity; texts without an entity are
returned byte for byte; entities are looked for kind by kind (e-mail, IBAN, card, social security, IP, phone, name), each in
what the kinds before left, and of every start the longest valid end is taken;
repeated rows give equal rows; an empty table gives an empty result; extra columns pass through,
those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.shared import bounded_batches, written

KEY = b"docmill-surrogates-1"
MAX_SENT = 200_000
#: Rounds of the collision check, and how many in a row may settle nothing; a value is refused in one with a chance of originals / values of its shape.
MAX_WALK, IDLE_ROUNDS = 64, 8
#: Capitalized words taken behind a title, besides the first.
MORE = 3

# Common given names by gender and script.
GIVEN = {
    ("f", "latin"): "Alice Amelia Anna Barbara Camille Carmen Caroline Catherine Charlotte Clara Elena Elizabeth Emily Emma Eva Florence Helen Ingrid Isabel Jane Jennifer Julia Karen Laura Linda Louise Lucia Margaret Maria Marie Martha Mary Monika Nicole Patricia Paula Rachel Sabine Sarah Sophie Susan Teresa Ursula Victoria".split(),
    ("m", "latin"): "Adam Albert Alexander Andrew Antonio Bernard Carlos Charles Christian Daniel David Diego Edward Eric Francisco Frank Franz George Hans Henry Jack James Jean Johann John Joseph Juan Karl Klaus Louis Lukas Manuel Mark Martin Matthew Michael Miguel Nicolas Oscar Otto Pablo Patrick Paul Peter Philip Pierre Richard Robert Stefan Thomas Werner William".split(),
    ("f", "cyrillic"): "Александра Алина Анна Вера Дарья Екатерина Елена Ирина Ксения Мария Надежда Наталья Ольга Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Игорь Константин Михаил Николай Олег Павел Сергей Юрий".split(),
    ("f", "greek"): "Αικατερίνη Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ειρήνη Μαρία Σοφία".split(),
    ("m", "greek"): "Αλέξανδρος Ανδρέας Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης Χρήστος".split(),
}
# Forms of address before a surname.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Господин Госпожа Κύριος Κυρία".split()

# Particles of surnames.
PARTICLES = "de la las los del della di da dal dos das du des van der den von vom zu zum le bin ibn ben al el ter ten af av".split()

# Phrases that introduce a person's full name.
INTRODUCTIONS = ("my name is", "My name is", "Name:", "Full name:", "Contact:", "Attn:", "Signed,", "Signed:", "Sincerely,", "Regards,", "je m'appelle", "Je m'appelle", "Nom :", "me llamo", "Me llamo", "Nombre:", "ich heiße", "Ich heiße")

# Function words that are no surname by themselves; they aren't followed through a text.
FUNCTION_WORDS = frozenset(
    "a an and are as at be but by for from had has he her his i if in is it its me my no not of on or our she so that the their they this to was we were who will with you your "
    "aber am auf aus bei das dem den der die ein eine er es für hat ich ihr im ist mit nach sie und von war wir zu au aux ce de des dit du elle en est et il je la le les leur lui ne on ou par pas pour qui que sa se ses son sur un une "
    "al como con del el ella los las lo para pero por se su sus una uno y и в во на не он она они это как но что с со к по за из ο η το και να με σε".split()
)

_GENDER = {name: group for group, names in GIVEN.items() for name in names}
_CAPITALS = {name.upper(): name for name in _GENDER}
_UP = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω"
_SURNAME = rf"[{_UP}][^\W\d_]+(?:-[{_UP}][^\W\d_]+)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Phones without '+' or brackets: North American with and without trunk, local; French pairs; behind a trunk 0; nine or ten digits in groups.
_LOCAL = (
    r"(?:1[ .-])?\d{3}(?P<us>[ .-])\d{3}(?P=us)\d{4}|[2-9]\d{2}-\d{4}|0[1-9](?P<fr>[ .-])\d{2}(?:(?P=fr)\d{2}){3}"
    r"|0\d{1,4}(?:[ ./-]\d{2,8}){1,4}|[1-9]\d{1,3}(?P<any>[ -])\d{2,4}(?:(?P=any)\d{2,4}){1,3}"
)
#: Those whose end is known.
_LOCAL_FIRST = _LOCAL[: _LOCAL.index("|0\\d{1,4}")]
PATTERNS = {
    "email": re.compile(r"(?<![\w.%+-])[A-Za-z0-9_%+-]+(?:['.][A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "card": re.compile(r"(?<![\w+])\d(?:[ -]?\d)*"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "ip": re.compile(rf"(?<![\w.])(?<!ersion ){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"),
    "phone": re.compile(r"(?<![\w+.])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,5}){2,6}|(?<![\w+.])\(\d{2,4}\) ?\d{2,4}(?:[ .-]\d{2,4}){1,3}|(?<![\w+.-])(?:" + _LOCAL + ")"),
}
_RUN, _DIGITS = PATTERNS["card"], re.compile(r"\d+")
#: How digits stand on cards, besides in one group.
_CARD_GROUPS = frozenset({(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3), (4, 4, 5), (6, 13)})
# Least and most digits behind a country code; where a code isn't listed, 7 to 15 with it.
_NATIONAL = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9), "43": (4, 13), "44": (9, 10),
    "45": (8, 8), "46": (7, 9), "47": (8, 8), "48": (9, 9), "49": (5, 11), "52": (10, 10), "54": (10, 11), "55": (10, 11), "61": (9, 9), "64": (8, 10), "81": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10),
    "351": (9, 9), "352": (5, 9), "353": (7, 9), "357": (8, 8), "358": (5, 12), "359": (7, 9), "370": (8, 8), "380": (9, 9), "385": (8, 9), "386": (8, 8), "420": (9, 9), "421": (9, 9),
}
#: What may stand right before a surname: particles, and a letter with an apostrophe.
_BEFORE = rf"(?:(?:{'|'.join(PARTICLES)})[ ]+){{0,3}}(?:[A-Z]['’])?"
_NAME = re.compile(
    rf"(?<!\w)(?:(?:{'|'.join(TITLES)})\.?[ ]+)?(?P<given>{'|'.join(sorted([*_GENDER, *_CAPITALS], key=len, reverse=True))})[ ]+(?:[{_UP}]\.?[ ]+){{0,2}}{_BEFORE}(?P<surname>{_SURNAME})(?!\w)"
    rf"|(?<!\w)(?:{'|'.join(TITLES)})\.?[ ]+(?:[{_UP}]\.[ ]+){{0,2}}{_BEFORE}(?P<only>{_SURNAME})(?!\w)"
)
_NEXT = re.compile(rf"[ ]+(?:[{_UP}]\.[ ]+){{0,2}}{_BEFORE}(?P<more>{_SURNAME})(?!\w)")
_INTRODUCED = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, INTRODUCTIONS))})\s+(?P<name>{_SURNAME}(?:[ ]+{_SURNAME}){{1,2}})(?!\w)")
_WORD = re.compile(_SURNAME)
_CAPITALIZED = re.compile(rf"(?<!\w)[{_UP}][^\W\d_]*(?:-[{_UP}][^\W\d_]*)*(?!\w)")
_LETTERS = re.compile(r"[^-]+")
_CUES = frozenset(_GENDER) | frozenset(_CAPITALS) | frozenset(TITLES) | {t + "." for t in TITLES}
_DIGIT_OR_AT = re.compile(r"[\d@]")
_SPLIT = re.compile(r"[^\w.]+")

#: Alphabets; a symbol is only ever replaced by one of its own.
_CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
_CLASS = {c: s for s in _CLASSES for c in s}


def luhn(digits: str) -> int:
    """The check digit that belongs behind `digits`."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _closed(text: str, end: int) -> bool:
    """Whether a word ends there."""
    return end == len(text) or not (text[end].isalnum() or text[end] == "_")


def _national(value: str) -> bool:
    """Whether a number with a country or bracketed area code has as many digits as numbers of that plan."""
    digits = [c for c in value.replace("(0)", "") if c.isdecimal()]
    if value[0] not in "+(":
        return re.fullmatch(_LOCAL_FIRST, value) is not None
    if value[0] == "(":
        return len(digits) == 10 if int(digits[0]) else 9 <= len(digits) <= 12
    code = next((c for k in (3, 2, 1) if (c := "".join(str(int(d)) for d in digits[:k])) in _NATIONAL), None)
    return code is not None and _NATIONAL[code][0] <= len(digits) - len(code) <= _NATIONAL[code][1]


_DATE = re.compile(r"(?:\d{1,2}([ ./-])\d{1,2}\1|\d{1,2}[ ./-])?(?:19|20)\d{2}(?!\d)|(?:19|20)\d{2}([ ./-])(?:0?[1-9]|1[0-2])\2(?:0?[1-9]|[12]\d|3[01])(?!\d)")


def _grouped(value: str) -> bool:
    """Whether digits without '+' or brackets are grouped as in phone numbers and don't read as a date, years, a version or a plain number."""
    groups = _DIGITS.findall(value)
    sizes, n = [len(g) for g in groups], sum(map(len, groups))
    if sizes in ([3, 3, 4], [1, 3, 3, 4]):
        return True
    if sizes == [3, 4] and value[3] == "-":
        return int(value[0]) > 1
    if _DATE.match(value):
        return False
    if int(value[0]) == 0:
        return 9 <= n <= 11 and len(groups) > 1 and ("." not in value or sizes == [2] * 5)
    return 9 <= n <= 10 and not all(x == 3 for x in sizes[1:]) and any(x > 2 for x in sizes)


def _valid(kind: str, value: str) -> bool:
    plain = re.sub(r"\W", "", value)
    if kind == "iban":
        return iban_check(plain[:2], plain[4:]) == plain[2:4]
    if kind == "phone":
        return 7 <= len(plain) <= 15 if value[0] in "+(" else _grouped(value)
    return True


def _spans(kind: str, text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Entities of a kind between two places: of every start the longest valid end, for phones one of the national length first."""
    pattern = PATTERNS[kind]
    while m := pattern.search(text, a, b):
        start, end = m.span()
        if kind in ("iban", "phone"):
            open_ = (lambda e: text[e : e + 1] == "-" or (text[e : e + 1] == "." and text[e + 1 : e + 2].isdecimal())) if kind == "phone" else lambda e: False
            ends = [e for e in range(end, start, -1) if text[e - 1].isalnum() and _closed(text, e) and not open_(e) and pattern.fullmatch(text, start, e) and _valid(kind, text[start:e])]
            if kind == "phone":
                ends.sort(key=lambda e: not _national(text[start:e]))
            end = ends[0] if ends else 0
        elif kind != "email" and not _closed(text, end):
            end = 0
        if end:
            yield start, end
        a = end or start + 1


def _cards(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Cards in runs of digit groups: those grouped as on cards anywhere, others from the start of what is left of a run."""
    for run in _RUN.finditer(text, a, b):
        if run.end() - run.start() < 13:
            continue
        groups = [m.span() for m in _DIGITS.finditer(text, *run.span())]

        def longest(i: int, stop: int, natural: bool, groups=groups) -> int:
            """The group behind the longest valid card from group i, 0 if there is none."""
            found, digits = 0, ""
            for j in range(i, stop):
                digits += text[slice(*groups[j])]
                if (n := len(digits)) > 19:
                    break
                sizes = tuple(y - x for x, y in groups[i : j + 1])
                if n >= 13 and (not natural or j == i or sizes in _CARD_GROUPS) and _closed(text, groups[j][1]) and luhn(digits[:-1]) == int(digits[-1]):
                    found = j + 1
            return found

        def taken(i: int, stop: int, natural: bool, groups=groups, longest=longest) -> Iterator[tuple[int, int]]:
            while i < stop:
                j = longest(i, stop, natural)
                if j:
                    yield i, j
                elif not natural:  # as far as one card reaches
                    n, k = 0, i
                    while k < stop and (n := n + groups[k][1] - groups[k][0]) <= 19:
                        k += 1
                    j = max(k, i + 1)
                i = j or i + 1

        fits = list(taken(0, len(groups), True))
        left = zip([0, *[y for _, y in fits]], [*[x for x, _ in fits], len(groups)], strict=True)
        for x, y in fits + [f for i, j in left for f in taken(i, j, False)]:
            yield groups[x][0], groups[y - 1][1]


def _bare(text: str, names: dict[str, str], found: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Other mentions, capitalized, of a text's names where nothing is found yet."""
    if not names:
        return
    spans = sorted((a, b) for a, b, _ in found)
    k = 0
    kind_of = lambda word: names.get(word) or names.get(_CAPITALS.get(word, "")) or names.get(lowered(word))
    for m in _CAPITALIZED.finditer(text):
        # A hyphenated name that isn't known as a whole may be so in parts.
        for one in [m] if kind_of(m.group()) else _LETTERS.finditer(text, *m.span()):
            a, b = one.span()
            while k < len(spans) and spans[k][1] <= a:
                k += 1
            if (kind := kind_of(one.group())) and (k == len(spans) or spans[k][0] >= b):
                yield a, b, kind


def _named(text: str) -> Iterator[tuple[int, int, str]]:
    """Names by the lists: behind a title all capitalized words (MORE besides the first), behind two given names one more."""
    at = 0
    while m := _NAME.search(text, at):
        for part in ("given", "surname", "only"):
            if m.group(part):
                yield (*m.span(part), "given" if part == "given" else "surname")
        at, more = m.end(), MORE if m.group("only") else int(m.group("surname") in _GENDER)
        while more and (n := _NEXT.match(text, at)) and lowered(n.group("more")) not in FUNCTION_WORDS:
            yield (*n.span("more"), "surname")
            at, more = n.end(), more - 1


def _free(spans: list[tuple[int, int, str]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that overlap none of those taken; both in order of place."""
    out, k = [], 0
    for a, b, kind in spans:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            out.append((a, b, kind))
    return out


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every entity, in order of place, none overlapping."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    if _DIGIT_OR_AT.search(text):
        for kind in PATTERNS:
            if kind == "email" and "@" not in text:
                continue
            # Only what earlier kinds left; their neighbours are found whole.
            gaps = zip([0, *[b for _, b, _ in out]], [*[a for a, _, _ in out], len(text)], strict=True)
            out += [(x, y, kind) for a, b in list(gaps) if a < b for x, y in (_cards(text, a, b) if kind == "card" else _spans(kind, text, a, b))]
            out.sort()
    listed = not _CUES.isdisjoint(_SPLIT.split(text))
    if listed or _INTRODUCED.search(text):
        names: dict[str, str] = {}
        persons = list(_named(text)) if listed else []
        persons = _free(persons, out)
        persons += _free([(*w.span(), "given" if w.group() in _GENDER else "surname") for m in _INTRODUCED.finditer(text) for w in _WORD.finditer(text, *m.span("name"))], sorted(out + persons))
        for a, b, kind in persons:
            if lowered(text[a:b]) not in FUNCTION_WORDS:
                names[canonical(kind, text[a:b])] = kind
                names |= {lowered(part): kind for part in text[a:b].split("-") if "-" in text[a:b] and kind == "surname"}
        out += persons
        out += _bare(text, names, out)
    return sorted(out)


def lowered(text: str) -> str:
    """Lower case of the same length: characters whose lower case is longer (U+0130) stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def canonical(kind: str, mention: str) -> str:
    """One form for all spellings of a value; digits of other scripts count as ASCII ones."""
    if kind in ("card", "ssn", "ip", "phone") and not mention.isascii():
        mention = "".join(str(int(c)) if c.isdecimal() else c for c in mention)
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", mention)
    if kind == "phone":
        code = re.match(r"\+\d{1,3}(?=\D)", mention)
        return (code.group() + "|" if code else "+|" if mention[0] == "+" else "") + re.sub(r"\D", "", mention[code.end() if code else 0 :])
    if kind == "iban":
        return mention.replace(" ", "")
    return _CAPITALS.get(mention, mention) if kind == "given" else lowered(mention)


class Surrogates:
    """The keyed permutations."""

    def __init__(self, key: bytes = KEY) -> None:
        self.key = key
        self.of = lru_cache(1 << 16)(self._of)

    def _number(self, *parts: object) -> int:
        return int.from_bytes(hmac.new(self.key, repr(parts).encode(), hashlib.sha256).digest(), "big")

    def _permute(self, value: int, left: int, right: int, tweak: object) -> int:
        """A permutation of range(left * right): eight rounds of a Feistel network on its two parts."""
        a, b = divmod(value, right)
        for r in range(8):
            a = (a + self._number(tweak, r, "a", b)) % left
            b = (b + self._number(tweak, r, "b", a)) % right
        return a * right + b

    def _restore(self, value: int, left: int, right: int, tweak: object) -> int:
        """The inverse of _permute."""
        a, b = divmod(value, right)
        for r in reversed(range(8)):
            b = (b - self._number(tweak, r, "b", a)) % right
            a = (a - self._number(tweak, r, "a", b)) % left
        return a * right + b

    def _move(self, symbols: list[str], alphabets: list[tuple[str, ...] | str], tweak: object) -> list[str]:
        """Each symbol within its alphabet, all together permuted; no value stays itself where there is another.

        Values are permuted, shifted by a keyed number that isn't 0, and permuted back: one to one, and without a fixed point as the shift has none.
        """
        sizes = [len(s) for s in alphabets]
        half, left, right = len(sizes) // 2, 1, 1
        for i, n in enumerate(sizes):
            left, right = (left * n, right) if i < half else (left, right * n)
        if (total := left * right) == 1:
            return list(symbols)
        value = 0
        for x, s in zip(symbols, alphabets, strict=True):
            value = value * len(s) + s.index(x)
        way = (left, right, (tweak, tuple(sizes)))
        shift = 1 + self._number("shift", way) % (total - 1)
        moved = self._restore((self._permute(value, *way) + shift) % total, *way)
        out = []
        for s in reversed(alphabets):
            moved, k = divmod(moved, len(s))
            out.append(s[k])
        return out[::-1]

    def _shaped(self, text: str, tweak: object) -> str:
        """Characters with an alphabet moved, the others kept."""
        at = [i for i, c in enumerate(text) if c in _CLASS]
        out = list(text)
        for i, c in zip(at, self._move([text[i] for i in at], [_CLASS[text[i]] for i in at], (tweak, "".join("." if c in _CLASS else c for c in text))), strict=True):
            out[i] = c
        return "".join(out)

    def _of(self, kind: str, value: str) -> str:
        """The surrogate of a canonical value, canonical itself."""
        if kind == "email":
            local, _, host = value.partition("@")
            name, dot, top = host.rpartition(".")
            return f"{self._shaped(local, ('local', host))}@{self._shaped(name, 'host')}{dot}{top}"
        if kind == "card":
            body = value[0] + self._shaped(value[1:-1], ("card", value[0], len(value)))
            return body + str(luhn(body))
        if kind == "iban":
            account = self._shaped(value[4:].lower(), ("iban", value[:2])).upper()
            return value[:2] + iban_check(value[:2], account) + account
        if kind == "ip":
            octets = [int(o) for o in value.split(".")]
            ranges = [range(1, 224), range(256), range(256), range(1, 255)]
            groups = [tuple(map(str, r)) if o in r else tuple(str(x) for x in range(256) if x not in r) for o, r in zip(octets, ranges, strict=True)]
            return ".".join(self._move([str(o) for o in octets], groups, "ip"))
        if kind == "phone":
            code, bar, rest = value.rpartition("|")
            leading = rest[0] if rest[0] in "01" else "23456789"
            return code + bar + "".join(self._move(list(rest), [leading, *["0123456789"] * (len(rest) - 1)], ("phone", code, len(rest))))
        if kind == "given":
            names = GIVEN[_GENDER[value]]
            order = sorted(names, key=lambda n: self._number("given", n))
            return order[(order.index(value) + 1 + self._number("shift", len(order)) % (len(order) - 1)) % len(order)]
        return self._shaped(value, kind)


def dress(kind: str, mention: str, surrogate: str) -> str:
    """A canonical surrogate in the spelling of the mention: its separators and capitals."""
    if kind in ("given", "ip"):
        return surrogate.upper() if kind == "given" and mention in _CAPITALS else surrogate
    source = iter(surrogate.rpartition("|")[2] if kind == "phone" else surrogate)
    if kind == "phone":
        code = re.match(r"\+\d{1,3}(?=\D)", mention)
        head = code.end() if code else 0
        return mention[:head] + "".join(next(source) if c.isdigit() else c for c in mention[head:])
    if kind in ("email", "surname"):
        return "".join((u if len(u := s.upper()) == 1 else c) if c.isupper() else s for c, s in zip(mention, source, strict=True))
    return "".join(next(source) if c.isalnum() else c for c in mention)


_WALKED = ("email", "iban", "card", "ssn", "ip", "phone", "surname")


def entities(df: DataFrame, text: str = "text") -> DataFrame:
    """The distinct (kind, value) of all texts, values canonical."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[str, str]] = set()
            for t in batch.column(0).to_pylist():
                seen.update((kind, canonical(kind, t[a:b])) for a, b, kind in find(t))
            rows = sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], names=["kind", "value"])

    return df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "kind string, value string").distinct()


def with_surrogates(found: DataFrame, key: bytes = KEY, source: str = "value", to: str = "surrogate") -> DataFrame:
    @F.pandas_udf("string")
    def image(kinds, values):
        import pandas as pd

        s = Surrogates(key)
        return pd.Series([s.of(k, v) for k, v in zip(kinds, values, strict=True)], dtype=object)

    return found.withColumn(to, image("kind", source))


def walked(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, value, surrogate) of the originals whose first surrogate is an original too, with another one.

    Round after round the originals left take their images under the round's own permutation; an
    image is refused if it is an original, or the surrogate of another in an earlier round.  Within a
    round images are distinct, so all are.  Refusals are joins, over ever fewer rows.
    """
    found = found.where(F.col("kind").isin(*_WALKED))
    originals = found.select("kind", F.col("value").alias("surrogate"))
    first, _ = written(with_surrogates(found, key), "surrogates")
    # What has no other value to go to (a surname without a letter of the alphabets) stays.
    left, _ = written(first.where("surrogate <> value").join(originals, ["kind", "surrogate"], "left_semi").select("kind", "value"), "clashes")
    taken = first.join(originals, ["kind", "surrogate"], "left_anti").select("kind", "surrogate")
    out, idle = None, 0
    for r in range(1, MAX_WALK):
        if idle == IDLE_ROUNDS or left.isEmpty():
            break
        asked = with_surrogates(left, key + b"#%d" % r)
        good, _ = written(asked.join(originals, ["kind", "surrogate"], "left_anti").join(taken, ["kind", "surrogate"], "left_anti").select("kind", "value", "surrogate"), "surrogates")
        if good.isEmpty():
            idle += 1
            continue
        idle = 0
        out = good if out is None else out.unionByName(good)
        taken = taken.unionByName(good.select("kind", "surrogate"))
        left, _ = written(left.join(good, ["kind", "value"], "left_anti"), "clashes")
    return out if out is not None else found.sparkSession.createDataFrame([], "kind string, value string, surrogate string")


def collisions(pairs: DataFrame) -> DataFrame:
    """Surrogates that stand for two originals, or are originals themselves; empty if all is well."""
    shared = pairs.groupBy("kind", "surrogate").agg(F.count_distinct("value").alias("n")).where("n > 1").select("kind", "surrogate")
    own = pairs.where(F.col("kind").isin(*_WALKED)).select("kind", "surrogate").join(pairs.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_semi")
    return shared.unionByName(own).distinct()


def replaced(df: DataFrame, text: str = "text", key: bytes = KEY, max_sent: int = MAX_SENT) -> DataFrame:
    """df with its text column replaced, n_entities, and entities (kind, start, end in the old text, surrogate)."""
    spark = df.sparkSession
    bounded_batches(spark)
    exceptions = walked(written(entities(df, text), "entities")[0], key)
    n = max(1, -(-exceptions.count() // max_sent))
    entity = "array<struct<kind: string, start: int, end: int, surrogate: string>>"
    names = ["n_entities", "entities"]
    order = [c for c in df.columns if c not in names]
    out = df.select(*[F.col(f"`{c}`") for c in order], F.lit(0).alias("n_entities"), F.array().cast(entity).alias("entities"))
    for k in range(n):
        part = exceptions if n == 1 else exceptions.where(F.pmod(F.xxhash64("kind", "value"), F.lit(n)) == k)
        sent = spark.sparkContext.broadcast({(r["kind"], r["value"]): r["surrogate"] for r in part.collect()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=k == 0, last=k == n - 1) -> Iterator[pa.RecordBatch]:
            surrogates, known = Surrogates(key), sent.value
            kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
            for batch in batches:
                at = batch.schema.get_field_index
                texts, lists = batch.column(at(text)).to_pylist(), batch.column(at("entities")).to_pylist()
                for i, t in enumerate(texts):
                    if first:
                        lists[i] = [{"kind": kind, "start": a, "end": b, "surrogate": surrogates.of(kind, canonical(kind, t[a:b]))} for a, b, kind in find(t)]
                    for e in lists[i]:
                        e["surrogate"] = known.get((e["kind"], canonical(e["kind"], t[e["start"] : e["end"]])), e["surrogate"])
                    if last and lists[i]:
                        cut, pieces = 0, []
                        for e in lists[i]:
                            mention = t[e["start"] : e["end"]]
                            e["surrogate"] = dress(e["kind"], mention, e["surrogate"])
                            pieces += [t[cut : e["start"]], e["surrogate"]]
                            cut = e["end"]
                        texts[i] = "".join([*pieces, t[cut:]])
                new = {text: pa.array(texts, pa.string()), "n_entities": pa.array([len(x) for x in lists], pa.int32()), "entities": pa.array(lists, kind_of)}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], names=batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replaced(docs).select("doc_id", "text", F.col("n_entities").cast("long").alias("n_entities"), F.concat_ws(",", F.transform("entities", lambda e: e["kind"])).alias("kinds"))


