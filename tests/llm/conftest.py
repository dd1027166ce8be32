from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def documents(spark):
    """Texts to a documents table: ids count from 0 unless a row brings its own."""

    def make(rows, source="s"):
        full = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            [(i, t, "en", source, None if t is None else len(t)) for i, t in full],
            "doc_id long, text string, lang string, source string, n_chars long",
        )

    return make


@pytest.fixture
def odd_documents(spark):
    """NULLs in any column, empty and blank texts, repeated rows, columns with clashing names."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, "one", "en", None, 3),
        (4, "one", "en", None, 3),
        (None, "no id here at all but some words " * 4, "de", "b", 10),
        (5, "x" * 50_000, "en", "b", 50_000),
        (6, "word " * 40_000, "en", "b", 200_000),
        (7, "Ein ganz normaler Satz mit ein paar Wörtern.\nUnd noch einer mit wörtern darin.", None, "b", 60),
    ]
    names = ("id", "sig", "n", "kind", "key", "size", "lo", "hi", "blob", "rank", "spans", "target", "label", "score")
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {n} string" for n in names)
    return spark.createDataFrame([r + ("x",) * len(names) for r in rows], schema)
