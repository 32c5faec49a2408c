"""Dates, JSON answers, base64 payloads, sizes and vectors as Column expressions."""

from __future__ import annotations

import hashlib
import math
import string

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Attachment types read as text, and the vision formats.
TEXT_TYPES = ("text/plain", "text/csv", "text/markdown", "application/json", "application/xml", "text/xml")
TEXT_EXTENSIONS = ("txt", "csv", "md", "json", "xml")
IMAGE_EXTENSIONS = ("png", "jpeg", "jpg", "gif", "webp")
IMAGE_BYTES = 20 << 20
# Processors by content type and by extension.
PROCESSORS = {
    "application/pdf": "pdf", "text/plain": "text", "text/csv": "text",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/xml": "xml", "text/xml": "xml",
    "image/png": "image", "image/jpeg": "image", "image/jpg": "image", "image/gif": "image", "image/webp": "image",
}
EXTENSION_PROCESSORS = {"pdf": "pdf", "txt": "text", "csv": "text", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "xml": "xml", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image"}
CONTENT_TYPES = {"pdf": "application/pdf", "txt": "text/plain", "csv": "text/csv", "xml": "application/xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "json": "application/json", "html": "text/html"}


def literal_map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def content_type(asked: Column, stored: Column, path: Column) -> Column:
    """What the request says, else the store, else the extension."""
    return F.coalesce(F.nullif(asked, F.lit("")), F.nullif(stored, F.lit("")), F.try_element_at(literal_map(CONTENT_TYPES), suffix(path)))


def processor(kind: Column, path: Column) -> Column:
    """By content type, else by extension; null if there is none."""
    return F.coalesce(F.try_element_at(literal_map(PROCESSORS), F.lower(kind)), F.try_element_at(literal_map(EXTENSION_PROCESSORS), suffix(path)))


def is_text_attachment(kind: Column, name: Column) -> Column:
    return F.coalesce(F.lower(kind).isin(*TEXT_TYPES), F.lit(False)) | suffix(name).isin(*TEXT_EXTENSIONS)


def is_image_attachment(kind: Column, name: Column) -> Column:
    return F.coalesce(F.lower(kind).startswith("image/"), F.lit(False)) | suffix(name).isin(*IMAGE_EXTENSIONS)


def decoded_text(content: Column) -> Column:
    """UTF-8 if it is, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def is_pdf(kind: Column, content: Column) -> Column:
    return F.coalesce(F.lower(kind).contains("application/pdf"), F.lit(False)) | (F.hex(F.substring(content, 1, 4)) == "25504446")


def date_slashed(text: Column) -> Column:
    """DD/MM/YYYY from four formats; what has that shape already, and what has none, stays."""
    t = F.trim(text)
    shaped = (F.length(t) == 10) & (F.length(F.regexp_replace(t, "[^/]", "")) == 2)
    formats = (("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"), ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"))
    parsed = F.coalesce(*[F.when(t.rlike(shape), F.date_format(F.try_to_date(t, fmt), "dd/MM/yyyy")) for fmt, shape in formats])
    return F.when(F.coalesce(t, F.lit("")) == "", "").when(shaped, t).otherwise(F.coalesce(parsed, t))


def relevant(answer: Column) -> Column:
    """A model's answer {"relevant": ...} as a boolean: JSON, an object inside the text, the words alone; false if unclear.

    As JSON any value but false, null, 0 and empty ones counts as true, the string "false" included.
    """
    raw = F.trim(answer)
    value = F.get_json_object(raw, "$.relevant")
    text_value = raw.rlike(r'"relevant"\s*:\s*"[^"]')
    whole = F.when(F.is_variant_null(F.try_parse_json(raw)).isNotNull() & raw.startswith("{") & raw.rlike(r'"relevant"\s*:'), F.when(text_value, True).otherwise(~F.coalesce(F.lower(value), F.lit("")).isin("false", "", "null", "0", "0.0", "[]", "{}")))
    inner = F.lower(F.regexp_extract(raw, r'(?i)\{[^}]*"relevant"\s*:\s*(true|false)[^}]*\}', 1))
    low = F.lower(raw)
    alone = low.contains("true") & ~low.contains("false")
    return F.coalesce(whole, F.when(inner != "", inner == "true"), F.when(low.rlike('"relevant": ?true'), True), F.when(low.rlike('"relevant": ?false'), False), alone, F.lit(False))


def retrieve_asked(answer: Column) -> Column:
    """A judge's answer {"retrieve": ...}: JSON, else the pair anywhere in the text; no answer means retrieve."""
    parsed = F.lower(F.get_json_object(answer, "$.retrieve"))
    found = F.lower(F.regexp_extract(answer, r'"?retrieve"?\s*[:=]\s*"?(True|False|true|false)"?', 1))
    value = F.coalesce(parsed, F.nullif(found, F.lit("")))
    return F.when(value.isin("true", "1", "yes", "on", "t", "y"), True).when(value.isin("false", "0", "no", "off", "f", "n"), False).otherwise(True)


def attachment(raw: Column, index: Column) -> Column:
    """file name, content type and payload of a plain string: data URL, `mime:payload` or payload alone."""
    t = F.trim(raw)
    data_url = t.startswith("data:")
    head = F.split_part(t, F.lit(":"), F.lit(1))
    typed = ~data_url & t.contains(":") & head.contains("/")
    kind = F.when(data_url, F.nullif(F.regexp_extract(t, "^data:([^;]*)", 1), F.lit(""))).when(typed, head)
    extensions = literal_map({v: "." + k for k, v in {"txt": "text/plain", "csv": "text/csv", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "json": "application/json", "html": "text/html", "xml": "text/xml"}.items()})
    name = F.concat(F.lit("attachment_"), (index + 1).cast("string"), F.coalesce(F.try_element_at(extensions, kind), F.lit("")))
    payload = F.when(typed, F.regexp_replace(t, "^[^:]*:", "")).otherwise(t)
    return F.when(t == "", F.raise_error(F.lit("Attachment string is empty")).cast("struct<filename: string, content_type: string, data: string>")).otherwise(F.struct(name.alias("filename"), kind.alias("content_type"), payload.alias("data")))


def payload_bytes(data: Column) -> Column:
    """The bytes of a base64 payload or data URL."""
    return F.unbase64(F.when(F.trim(data).startswith("data:"), F.regexp_replace(F.trim(data), "^[^,]*,", "")).otherwise(F.trim(data)))


def payload_type(data: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(data), "^data:([^;,]*)", 1), F.lit(""))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


class _Places(dict):
    """The first hex digit of each token's MD5; emptied when it has very many."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        place = self[token] = hashlib.md5(token).digest()[0] >> 4
        return place


_PLACES = _Places()
#: Bytes of UTF-8 with all but lower-case ASCII letters and digits made spaces.
_TOKEN_BYTES = bytes(b if chr(b) in string.ascii_lowercase + string.digits else 32 for b in range(256))


def _hashed(text: str) -> list[float]:
    places = bytes(map(_PLACES.__getitem__, text.lower().encode().translate(_TOKEN_BYTES).split()))
    counts = [float(places.count(place)) for place in range(16)]
    size = math.sqrt(sum(c * c for c in counts))
    return [c / size for c in counts] if size else counts


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def hashed_vectors(lists: pd.Series) -> pd.Series:
    """A stand-in for a hosted embedder: for each text of a list its counts of tokens by the first digit of their MD5 in 16 places, of length 1."""
    return lists.map(lambda texts: None if texts is None else [_hashed(t) for t in texts])


def json_bytes(*columns: Column) -> Column:
    """UTF-8 bytes of a flat JSON object of the columns as Python writes it: a space behind commas and colons, null fields kept."""
    made = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.octet_length(made) + F.lit(2 * len(columns) - 1)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unit(vectors: pd.Series) -> pd.Series:
    def one(v):
        v = np.asarray(v, np.float64)
        n = np.linalg.norm(v)
        return (v / n if n else v).astype(np.float32)

    return vectors.map(one)
