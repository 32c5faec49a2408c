"""Text as Column expressions: tokens, estimates, slugs, file names, dates in addresses."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Italian months, in calendar order.
MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")
# Extensions of downloadable documents.
EXTENSIONS = (".pdf", ".zip", ".xlsx", ".xls", ".xml", ".xsd")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased; an accented letter ends a token."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def words(text: Column) -> Column:
    """Parts between runs of Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def estimate_down(text: Column) -> Column:
    """Words over 1.33, for chunk sizes."""
    return F.floor(n_words(text) / F.lit(1.33)).cast("int")


def estimate_up(text: Column) -> Column:
    """Four thirds of the words, for messages and chunks in reports."""
    return F.floor(n_words(text) * F.lit(1 / 0.75)).cast("int")


def estimate_cost(text: Column) -> Column:
    """Three quarters of the words, for cost reports."""
    return F.floor(n_words(text) * F.lit(0.75)).cast("int")


@F.pandas_udf(T.StringType())
def ascii_safe(texts: pd.Series) -> pd.Series:
    """Letters without their marks; what is still not ASCII becomes a question mark."""

    def one(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t
        plain = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
        return plain.encode("ascii", "replace").decode()

    return texts.map(one)


@F.pandas_udf(T.StringType())
def ascii_only(texts: pd.Series) -> pd.Series:
    """Compatibility form without anything that is not ASCII."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def trim_set(text: Column, characters: str) -> Column:
    """Without the given characters (a regular expression class) at both ends."""
    return F.regexp_replace(text, rf"^[{characters}]+|[{characters}]+$", "")


def or_default(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def slug_hyphen(text: Column, default: str = "documento") -> Column:
    return or_default(F.lower(trim_set(F.regexp_replace(ascii_only(text), "[^A-Za-z0-9]+", "-"), "-")), default)


def slug_underscore(text: Column, most: int = 64) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(text)), r"[^\x00-\x7F]", "")
    return F.left(trim_set(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "_"), F.lit(most))


def slug_safe(text: Column) -> Column:
    return or_default(trim_set(F.regexp_replace(text, r"[^A-Za-z0-9\-]+", "_"), "_"), "item")


def name_article(text: Column, most: int = 100) -> Column:
    marked = F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*\r\n\t]', "_"), r"\s+", "_")
    return or_default(F.left(trim_set(F.regexp_replace(marked, "_+", "_"), "_"), F.lit(most)), "untitled")


def name_foundation(text: Column) -> Column:
    return or_default(F.left(trim_set(F.regexp_replace(text, r'[<>:"/\\|?*]+', "_"), ". "), F.lit(200)), "document")


def name_order(text: Column) -> Column:
    return trim_set(F.trim(F.regexp_replace(text, r'[\\/:*?"<>|]+', "_")), "._")


def name_law(text: Column) -> Column:
    return or_default(trim_set(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_-]", "_"), "__+", "_"), "_"), "untitled")


def name_notary(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*]', "_"), r"\s+", " "))


def name_export(text: Column) -> Column:
    """Letters, digits, space, hyphen and underscore; spaces become underscores; 50 characters."""
    return F.left(F.replace(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N} \-_]", "")), F.lit(" "), F.lit("_")), F.lit(50))


@F.pandas_udf(T.StringType())
def _cut_bytes(names: pd.Series, most: pd.Series) -> pd.Series:
    def one(name: str | None, limit: int) -> str | None:
        raw = (name or "").encode()
        if name is None or len(raw) <= limit:
            return name
        tail = min(100, limit - 6)
        return raw[: limit - 5 - tail].decode(errors="ignore") + "_____" + raw[-tail:].decode(errors="ignore")

    return pd.Series([one(n, m) for n, m in zip(names, most, strict=True)], dtype=object)


def object_name(name: Column, folder: Column, most: int = 1024) -> Column:
    """A name cut in its middle so that folder, slash and name fit in `most` bytes; too long a folder is an error."""
    room = F.lit(most) - F.when(F.coalesce(folder, F.lit("")) != "", F.octet_length(folder) + 1).otherwise(0)
    return F.when(room <= 6, F.raise_error(F.lit("Folder path too long for an object name"))).otherwise(_cut_bytes(name, room)).cast("string")


def folder(path: Column) -> Column:
    """Slashes only, none at the ends; null if nothing is left."""
    return F.nullif(trim_set(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.lit(""))


def target_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def first_segment(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_clean(url: Column) -> Column:
    """Without its fragment and slashes at the end."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def absolute(href: Column, page: Column) -> Column:
    """href seen from page: absolute, of the same scheme, of the same host, or beside the page; dots are resolved."""
    root = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    beside = F.regexp_replace(F.regexp_replace(page, "[?#].*$", ""), r"(?<=[^/:])/[^/]*$|(?<=://[^/]{1,255})$", "/")
    full = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#") | href.startswith("?"), F.concat(F.regexp_replace(page, "#.*$", ""), href))
        .otherwise(F.concat(beside, href))
    )
    return _without_dots(full)


def _without_dots(url: Column) -> Column:
    """`.` and `..` in a path resolved, however many; those above the root stay."""
    whole = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/|[^/?#]*/)([^?#]*)(.*)$"
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(part == ".", done).when(up, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    path = F.regexp_extract(url, whole, 2)
    # A dot at the end leaves the folder.
    parts = F.split(F.regexp_replace(path, r"(^|/)(\.\.?)$", "$1$2/"), "/")
    clean = F.array_join(F.aggregate(parts, none, step), "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.regexp_extract(url, whole, 1), clean, F.regexp_extract(url, whole, 3))).otherwise(url)


def url_slug(url: Column) -> Column:
    return F.replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), F.lit(".html"), F.lit(""))


def extension(url: Column, default: str | None = None) -> Column:
    """The longest known extension at the end of the path, else anywhere in it."""
    low = F.lower(url_path(url))
    order = sorted(EXTENSIONS, key=len, reverse=True)
    at_end = F.coalesce(*[F.when(low.endswith(e), F.lit(e)) for e in order])
    inside = F.coalesce(*[F.when(low.contains(e), F.lit(e)) for e in order])
    return F.coalesce(at_end, inside, F.lit(default).cast("string"))


def year(text: Column, pattern: str = r"(19\d{2}|20\d{2})") -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def month_by_calendar(text: Column) -> Column:
    """Of the months named in text the first of the year."""
    return F.initcap(F.get(F.filter(F.array(*[F.lit(m) for m in MONTHS]), lambda m: F.contains(F.lower(text), m)), F.lit(0)))


def month_by_place(text: Column) -> Column:
    """The month named first in text."""
    return F.initcap(F.nullif(F.regexp_extract(F.lower(text), f"({'|'.join(MONTHS)})", 1), F.lit("")))


def hierarchy(url: Column) -> Column:
    path = F.lower(url_path(url))
    return F.filter(F.array(year(path), month_by_calendar(path)), lambda x: x.isNotNull())


def year_of_title(title: Column) -> Column:
    return or_default(F.regexp_extract(title, r"(\d{4})", 1), "sconosciuto")


def document_class(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("circolar"), "circolari").when(low.contains("messagg"), "messaggi").otherwise("altri")


def file_name(link_text: Column, url: Column, dashes: str = "-–", quote: bool = False) -> Column:
    """A file name from the link's text, else from the address, else from its hash."""
    ext = extension(url, ".pdf")
    bad = r'[<>:\\|/?*\n\r\t"]' if quote else r"[<>:\\|/?*\n\r\t]"
    hint = rf"(?i)\s*[{dashes}]\s*(pdf|zip|xlsx|xls|xml|xsd)\s*$"
    shown = F.left(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(link_text), hint, ""), bad, "_"), r"\s+", " "), F.lit(200))
    shown = F.when(F.lower(shown).endswith(ext), shown).otherwise(F.concat(shown, ext))
    last = F.try_url_decode(base_name(url_path(url)))
    hashed = F.concat(F.lit("document_"), F.left(F.md5(url), F.lit(8)), ext)
    return F.when(F.coalesce(link_text, F.lit("")) != "", shown).when(last.contains("."), last).otherwise(hashed)


def file_name_notary(link_text: Column, url: Column) -> Column:
    """Cleaned before the hint goes; addresses under /documents/ are PDF files."""
    ext = F.coalesce(extension(url), F.when(F.lower(url).contains("/documents/"), F.lit(".pdf")), F.lit(".pdf"))
    shown = F.regexp_replace(name_notary(link_text), r"(?i)\s*[-–]\s*(pdf|zip|xlsx|xls|xml|xsd)\s*$", "")
    return F.when(F.lower(shown).endswith(ext), shown).otherwise(F.concat(shown, ext))


def file_name_download(url: Column) -> Column:
    """The query parameter nomeFile, else the path's last part; always a PDF name."""
    asked = F.try_url_decode(F.nullif(F.regexp_extract(url, r"[?&]nomeFile=([^&#]*)", 1), F.lit("")))
    name = name_order(F.coalesce(asked, F.nullif(base_name(url_path(url)), F.lit("")), F.lit("documento.pdf")))
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


# Fixed value: how a decree's title names its date and number.
_DECREE = r"(?i)(\d{1,2})\s+(\w+)\s+(\d{4}),?\s*n\.?\s*(\d+)"


def decree_name(title: Column) -> Column:
    """dlgs_DD_month_YYYY_n_N.txt from a title that names date and number, else its cleaned text."""
    part = lambda k: F.regexp_extract(title, _DECREE, k)
    exact = F.concat(F.lit("dlgs_"), F.lpad(part(1), 2, "0"), F.lit("_"), F.lower(part(2)), F.lit("_"), part(3), F.lit("_n_"), part(4), F.lit(".txt"))
    rest = F.nullif(F.left(trim_set(F.regexp_replace(F.regexp_replace(title, "[^A-Za-z0-9_-]", "_"), "__+", "_"), "_"), F.lit(100)), F.lit(""))
    return F.when(part(4) != "", exact).otherwise(F.concat(F.lit("dlgs_"), rest, F.lit(".txt")))


# The prefix of an author line, names glued by "e", a contribution glued to its name, and names joined by "e".
_BY, _GLUED, _CONTRIBUTION, _AND = r"^di\s*", r"(\w)e([A-Z])", "(contributo di)([A-Z])", r"\s+e\s+"


def author_detail(author: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(author, _BY, ""), _GLUED, "$1 e $2")
    return F.regexp_replace(spaced, _CONTRIBUTION, "$1 $2")


def author_list(author: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(author, _BY, ""), _AND, ", "), r"\s+", " ")


def title_join(title: Column, subtitle: Column) -> Column:
    return F.concat_ws(". ", title, F.nullif(subtitle, F.lit("")))


def short_id(text: Column) -> Column:
    return F.left(F.md5(text), F.lit(16))


# Words that titles glue to the word before.
GLUED = (r"(?iU)(\w+)(legge)\b", r"(?iU)(\w+)(decreto)\b")


def unglue(text: Column) -> Column:
    """A space before `legge` and `decreto` where they end a word."""
    for pattern in GLUED:
        text = F.regexp_replace(text, pattern, "$1 $2")
    return text


def bracketed(text: Column) -> Column:
    """The first text in brackets if it has more than 10 characters, cut at 500."""
    inner = F.trim(F.regexp_extract(text, r"\[([^\]]+)\]", 1))
    return F.when(F.length(inner) > 10, F.left(inner, F.lit(500)))


def output_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.txt$", "_output.txt")


def input_name(name: Column) -> Column:
    return F.regexp_replace(name, r"_output(\.txt)?$", "$1")


def strip_citations(text: Column) -> Column:
    """Citation marks (U+E200 and `cite` up to the end of the line) become a space."""
    return F.regexp_replace(text, "\\x{E200}cite.*", " ")


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def chunk_id(path: Column, page: Column, ordinal: Column, most: int = 512, name: Column | None = None) -> Column:
    """Name and hash of place: the same chunk has the same id in every run.  name: the path's base name made ASCII, where that is at hand."""
    return F.left(F.concat(ascii_safe(base_name(path)) if name is None else name, F.lit("-"), F.md5(F.concat_ws("/", path, page.cast("string"), ordinal.cast("string")))), F.lit(most))
