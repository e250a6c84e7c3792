import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("digest", "fp", "row_id", "rid", "kept", "copy_no", "winner", "key_0", "key_1", "text_hash", "id", "size", "piece_rid",
         "piece_parts", "piece_whole", "unit", "kind", "a.b")


@pytest.fixture(scope="session")
def hostile(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing further columns."""
    words = "the heron lifts off and glides over the quiet marsh while reeds bend in the wind".split()
    long = " ".join(words[(i * i + i // 7) % len(words)] for i in range(30_000))
    base = [
        (1, "The heron lifts off and glides over the quiet marsh.", "en", "a"),
        (2, "The heron lifts off and glides over the quiet marsh.", "en", "a"),
        (2, "The heron lifts off and glides over the quiet marsh.", "en", "a"),
        (3, None, "en", "a"), (4, "", None, "b"), (5, " \t\n ", "en", None), (None, "no id here at all", "en", "b"),
        (None, "no id here at all", "en", "b"), (None, None, None, None), (6, long, "en", "b"), (7, long + " end", "en", "b"),
        (8, "mail x@y.org or +1 (212) 555-0147, card 4111 1111 1111 1111", "en", "c"), (9, "1 2 3 !!", "en", "c"),
        (10, "Ein Reiher fliegt über das stille Moor und die Binsen.", "de", "c"),
        (11, "Released under the MIT License.", "en", "c"), (12, "▁ \x00 é \U0001f600 İ", "en", "d"),
        (13, "word", "en", "d"), (14, "Un héron vole sur le marais tranquille et les roseaux.", "fr", "d"),
    ]
    rows = [(*r, len(r[1]) if r[1] is not None else None, *[f"x{i}"] * len(CLASH)) for i, r in enumerate(base)]
    return spark.createDataFrame(rows, DOCS + "".join(f", `{c}` string" for c in CLASH)).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
