import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor " * 40


def document_rows():
    """Nulls in every column, empty and long texts, ties, exact and near copies, and texts in two scripts."""
    words = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were".split()
    rows = []
    for i in range(40):
        text = " ".join(words[(i * 7 + j * (i + 3)) % len(words)] + ("x" if (i + j) % 5 == 0 else "") for j in range(30 + 5 * i))
        rows.append((i, text, "en", "a" if i % 3 else "b"))
    for i in range(40, 60):
        rows.append((i, " ".join("größe über straße müssen können nicht einen würde"[k % 30:] for k in range(i - 30)), "de", None))
    rows += [(60, None, "en", "a"), (61, "", "de", "b"), (62, " \t\n", None, "b"), (63, rows[20][1], "en", "c"), (64, rows[20][1] + " tail", "en", "c"),
             (65, LONG * 20, "en", "c"), (66, "123 456 !!", "en", None), (None, rows[21][1], "en", "a"), (67, rows[22][1], "en", "a"), (67, rows[22][1], "en", "a"),
             (68, "é" * 70 + " " + rows[5][1], "fr", "é"), (69, "prefix " + rows[5][1][:120] + " suffix", "en", "a")]
    return [(*r, 1, "t") for r in rows]


SCHEMA = "doc_id bigint, text string, lang string, source string, score int, _null string"


@pytest.fixture(scope="session")
def docs(spark):
    """Two of the columns clash with names that operators add or use."""
    return spark.createDataFrame(document_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1]) for r in document_rows()]
