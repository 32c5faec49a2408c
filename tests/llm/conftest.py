import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choices(["the", "re", "on", "in", "ed", "ti", "an", "er"], k=r.randint(1, 4))) for _ in range(n))


def document_rows() -> list[tuple]:
    """Every odd case once: nulls, empty, copies, near copies, one long text, repeated rows, equal ids."""
    r = random.Random(5)
    base, other = words(r, 80), words(r, 90)
    parts = base.split(" ")
    near = " ".join([*parts[:40], "changed", *parts[41:]])
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "b", 1), (3, near, "fr", "a", 1), (4, other, None, None, None), (5, None, "en", "a", None), (6, "", "de", "b", 0),
        (7, "  \n\t ", "de", "b", 5), (8, "two words", "en", None, 9), (9, "two words", "en", "c", 9), (10, words(r, 20_000), "en", "a", 1), (None, words(r, 60), "en", "c", 1),
        (11, "Ünïcødé " + other, "de", "a", 1), (12, "x" * 500, "en", "a", 500), (13, "\0nul " * 30, None, "b", 1), (4, other, None, None, None), (4, "another text under the same id", "en", "a", 1),
        (14, "one line\n" * 60 + base, "en", "a", 1), (15, base + "\n" + other, "en", "a", 1), (16, other + " " + base, "en", "zz", 1), (None, None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return document_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory, docs):
    """A folder of tables with the rows above and a few others."""
    import shutil
    from pathlib import Path

    to = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{to}/documents.parquet")
    there = Path("/root/testdata/sf0.001")
    for name in ("benchmark", "pages", "labels"):
        shutil.copy(there / f"{name}.parquet", to / f"{name}.parquet")
    return str(to)
