from __future__ import annotations

import random

import pytest

from ..conftest import TESTDATA

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, found string, n_words string"

PROSE = "and the thing was hereon over there with that one from an other shore while rain fell on all the lands".split()


def prose(seed: int, n: int) -> str:
    """Words made of prose syllables: n of them, hardly ever the same for two seeds."""
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(PROSE) for _ in range(draw.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def docs_of(spark):
    """(id, text) pairs -> documents with further columns, of which some have names that operators use."""

    def build(rows):
        full = [(i, t, None, "src0", None if t is None else len(t), "clash", "clash", "clash") for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def folder_of(spark, tmp_path_factory):
    """DataFrames -> a folder with a Parquet table of each."""

    def build(**tables):
        folder = str(tmp_path_factory.mktemp("tables"))
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return build


@pytest.fixture(scope="session")
def small(spark):
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def small_docs(spark, small):
    """The (id, text) pairs of the smallest test table."""
    return [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


#: Nulls, empty and blank texts, repeated rows, a null id, one long word, letters beyond ASCII, lines, a very long text.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b "), (4, "word"), (5, "two words"), (5, "two words"), (None, prose(9, 70)), (6, "x" * 30_000),
    (7, "Ünïcödé wörds ß ñ 漢字 🙂 a🙂b"), (8, "line one\nline two\n\nline one\n line one\nline one"), (9, prose(5, 60) + "\n" + prose(5, 60)),
    (10, prose(11, 20_000)), (11, "a b c a b c a b c d"), (12, "\xa0no break\x00zero"), (13, prose(11, 20_000)),
]


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    return docs_of(ODD)


def key(row):
    return tuple((x is not None, x) if not isinstance(x, bool) else (True, int(x)) for x in row)


def same_rows(got, expected):
    """Both hold the same rows, whatever their order."""
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, map(tuple, expected)))
