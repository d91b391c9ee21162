"""Small tables with the cases that every operator must take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _h string, row int, text_2 string, component int, size string, cut int"
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old oak trees at night."


def _rows():
    words = [f"w{i}x" for i in range(400)]
    base = " ".join(words[:120])
    near = base.replace("w60x", "other")
    texts = [
        None,
        "",
        "   \t\n ",
        "12 34 !!",
        base,
        base,
        near,
        "Hello World. " + PASSAGE + " Then " + PASSAGE,
        "Another one\n" + PASSAGE + "\nA last line here",
        PASSAGE,
        "\n".join(["same line of seven words is here"] * 5),
        "one",
        "Ünïcödé Wörter ÄÖÜ äöü und noch mehr davon",
        " ".join(words) + "\n" + " ".join(f"long{i}" for i in range(20000)),
        "x\r\ny\n\nz\n",
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "zzz")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], rows[0], (None, base, None, None, None), (None, base, None, None, None), (None, None, None, None, None)]
    return [(*r, "clash", "clash", 7, "clash", 7, "clash", 7) for r in rows]


@pytest.fixture(scope="session")
def edge_rows():
    return _rows()


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
