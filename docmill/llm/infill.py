"""Fill-in-the-middle documents, by SQL functions alone.

A text is cut into units (runs of ASCII letters, or one other code point); a hash of the seed and
the row's id picks two cuts between units, whether the text stays plain, and one of two
arrangements.  prefix, suffix and middle then stand behind a sentinel each: `psm` is
`<P>prefix<S>suffix<M>middle`, `spm` is `<S>suffix<P>prefix<M>middle`.  Splitting the output at
the sentinels gives the text back.  Rows are independent: nothing is shuffled, and the same seed gives
the same output on every run.

Defined cases: a null text counts as empty and is plain, as is every text that holds a sentinel; a
null id is hashed as the empty string; texts of any length are cut whole (an array of their units
is held, some 60 bytes a unit); rows of one id share their hash and are cut by it each for itself; an
empty table gives an empty result; extra columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINEL = "<[PSM]>"
NAMES = ("n", "form", "output", "prefix_chars", "middle_chars")


def draws(row_id: Column, seed: int = 1, count: int = 4) -> list[Column]:
    """The first 8-digit groups of the hex SHA-256 of `seed:id`, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def arranged(df: DataFrame, row_id: str = "doc_id", text: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """df with n (units), form (plain, psm, spm), output, prefix_chars and middle_chars (code points, null if plain)."""
    kept = [c for c in df.columns if c not in NAMES]
    own = {f"__fim_{k}": F.col(f"`{c}`") for k, c in enumerate(kept)}
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    draw = dict(zip(("h1", "h2", "h3", "h4"), draws(F.col(f"`{row_id}`"), seed), strict=True))
    # Each step is a projection of its own, so that units and pieces are made once.
    cut = df.select(*[c.alias(n) for n, c in own.items()], whole.alias("whole"), *[c.alias(n) for n, c in draw.items()])
    cut = cut.withColumn("units", F.regexp_extract_all("whole", F.lit(UNIT), F.lit(0))).withColumn("n", F.size("units").cast("long"))
    first, second = (F.pmod(h, F.col("n") + 1) for h in ("h1", "h2"))
    cut = cut.withColumns({"a": F.least(first, second).cast("int"), "b": F.greatest(first, second).cast("int")})
    plain = (F.col("n") == 0) | F.col("whole").rlike(_SENTINEL) | (F.pmod("h3", F.lit(100)) >= 100 - plain_percent)
    cut = cut.withColumn("form", F.when(plain, F.lit("plain")).when(F.pmod("h4", F.lit(100)) < spm_percent, F.lit("spm")).otherwise(F.lit("psm")))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    cut = cut.withColumns(
        {"prefix": part(F.lit(1), F.col("a")), "middle": part(F.col("a") + 1, F.col("b") - F.col("a")), "suffix": part(F.col("b") + 1, F.col("n").cast("int") - F.col("b"))}
    )
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
        .otherwise(F.col("whole"))
    )
    return cut.select(*[F.col(n).alias(c) for n, c in zip(own, kept, strict=True)], "n", "form", output.alias("output"), F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: no part holds a sentinel, so the sentinels cut it into its parts."""
    part = F.split(output, _SENTINEL, -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return arranged(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM h),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM f),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END AS output FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'psm' THEN split_part(split_part(output, '<S>', 1), '<P>', 2) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1)
    WHEN 'spm' THEN split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || split_part(split_part(output, '<P>', 1), '<S>', 2) ELSE output END) AS restored_sha256
FROM o"""
