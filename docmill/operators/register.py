"""A professional register: fields out of page text, cleaning, keep-first, statistics, export groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import markup
from docmill.functions import text as X
from docmill.functions import values as V

# The fields of a register page and the patterns that find them.
FIELDS = {
    "nome_completo": r"Iscritto\s*:\s*([A-ZÀÈÉÌÒÙÁÍÓÚ][A-ZÀÈÉÌÒÙÁÍÓÚ\s\'-]+?)(?:\s*Nato|\n|$)",
    "luogo_nascita": r"Nato\s+a\s*:\s*([^,\n]+?)(?=\s*il\s*:|\n|$)",
    "data_nascita": r"il\s*:\s*(\d{2}/\d{2}/\d{4})",
    "ordine": r"Ordine\s+di\s*:\s*([^\n]+)",
    "data_anzianita": r"Data\s+anzianit[àa]\s*:\s*(\d{2}/\d{2}/\d{4})",
    "titolo_professionale": r"Titolo\s+professionale\s*:\s*([^\n]+)",
    "revisore_contabile": r"Revisore\s+contabile\s*:\s*(\w+)",
    "data_iscrizione": r"Iscritto\s+all['’]?\s*Albo\s*:\s*(\d{2}/\d{2}/\d{4})",
    "sezione": r"Sezione\s*:\s*([A-Z])",
    "altro_titolo": r"Altro\s+titolo\s+professionale\s*:\s*([^\n]+)",
    "sede_studio": r"Sede\s+studio\s*:\s*([^\n]+)",
    "data_modifica": r"Data\s+ultima\s+modifica\s*:\s*(\d{2}/\d{2}/\d{4})",
}
DATES = tuple(f for f in FIELDS if f.startswith("data_"))


def extracted(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages with the register's fields; empty where a pattern finds nothing."""
    found = {f: F.left(F.trim(F.regexp_extract(F.col(text), "(?is)" + p, 1)), F.lit(200)) for f, p in FIELDS.items()}
    return pages.withColumns(found)


def page_records(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the register's fields and `telefono`, read by place in the page; by pattern alone where it has no main block."""
    box = pages.withColumn("__box", markup.register_box(html)).withColumn("__lines", F.col("__box.lines"))
    name = F.nullif(F.left(F.trim(F.regexp_replace("__box.name", r"^[Ii]scritto\s*:?\s*", "")), F.lit(200)), F.lit(""))
    found = extracted(box, "__lines")
    office = F.coalesce(F.left("__box.address", F.lit(200)), F.col("sede_studio"))
    return found.withColumns({"nome_completo": F.coalesce(name, "nome_completo"), "sede_studio": office, "telefono": F.coalesce("__box.phone", F.lit(""))}).drop("__box", "__lines")


def pager_total(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"di\s+(\d+)", 1), F.lit("")).cast("int")


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of rows with the same keys the first; rows whose keys are all empty go.

    An aggregate keeps one row a key in every task before the shuffle, so a key may have any number of rows.
    """
    some = F.lit(False)
    for k in keys:
        some = some | (F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    best = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__first")
    return df.where(some).groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(best).select("__first.*")


def cleaned(records: DataFrame, upper: str = "revisore_contabile", dates: tuple[str, ...] = DATES, need: tuple[str, ...] = ("nome_completo", "ordine")) -> DataFrame:
    """Texts trimmed, the flag upper-cased, dates as DD/MM/YYYY; rows without any of the needed fields go."""
    have = [f for f in need if f in records.columns]
    some = F.lit(not have)
    for f in have:
        some = some | (F.coalesce(F.col(f), F.lit("")) != "")
    out = {}
    for name, kind in records.dtypes:
        if kind == "string":
            value = F.trim(name)
            out[name] = V.date_slashed(F.col(name)) if name in dates else F.upper(value) if name == upper else value
    return records.where(some).withColumns(out)


def built(pages: DataFrame, html: str, *order: str) -> DataFrame:
    """The register from its pages: fields read by place, cleaned, rows without a name and an order left out, the first of each name, order and birth kept."""
    return keep_first(cleaned(page_records(pages, html).drop(html)), ["nome_completo", "ordine", "data_nascita"], *order)


def statistics(records: DataFrame) -> DataFrame:
    """One row of counts over the register."""
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    return records.agg(
        F.count("*").alias("total"), F.count_distinct(filled("cap_code")).alias("caps"), F.count_distinct(filled("ordine")).alias("orders"), F.count_distinct(filled("nome_completo")).alias("names"),
        F.count_if(filled("sede_studio").isNotNull()).alias("with_office"), F.count_if(F.upper("revisore_contabile") == "SI").alias("auditors"),
    )


def processed(records: DataFrame, folder: str, source: str, processed_at: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """The register cleaned and kept first, exported three ways below folder (records.csv, by_ordine, records.json); returns it and its statistics before and after."""
    from docmill.sources import enveloped, tables

    before = statistics(records).withColumn("stage", F.lit("before"))
    kept = tables.written(keep_first(cleaned(records), ["nome_completo", "ordine", "data_nascita"], *order), "register")
    tables.write_csv(kept, f"{folder}/records.csv")
    tables.write_by_group(kept, f"{folder}/by_ordine", "ordine")
    enveloped.write_enveloped(kept, f"{folder}/records.json", source, processed_at)
    return kept, before.unionByName(statistics(kept).withColumn("stage", F.lit("after")))


def by_section(records: DataFrame, column: str = "sezione") -> DataFrame:
    """Rows by section; a missing one is Unknown, an empty one a group of its own."""
    return records.groupBy(F.coalesce(column, F.lit("Unknown")).alias("section")).agg(F.count("*").alias("n"))


def export_groups(records: DataFrame, column: str) -> DataFrame:
    """records with the file name of their export group."""
    return records.withColumn("export_name", X.name_export(F.col(column)))


def numeric_caps(caps: DataFrame) -> DataFrame:
    """Codes of five digits, once, in order."""
    return caps.where(F.col("cap_code").rlike("^[0-9]{5}$")).select("cap_code").distinct().orderBy("cap_code")


def postal_rows(pairs: DataFrame) -> DataFrame:
    """Rows of a postal table: a code of five digits or three and xx, a name without a code that isn't a heading; each pair once."""
    name = F.lower(F.trim("comune"))
    good = F.col("cap_code").rlike(r"^(\d{5}|\d{3}xx)$") & ~F.col("comune").rlike(r"\d{5}") & ~name.isin("comune", "cap", "---", "")
    return keep_first(pairs.where(good), ["cap_code", "comune"], "pos").drop("pos")
