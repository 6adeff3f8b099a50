import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def texts_of(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


CLASHING = "score string, fp string, copies int, size int, key int, spans int, x int, h int, node int, copy int, y int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, texts and sources, empty and long texts, repeated rows, and columns named like the operators' own."""
    words = "one two three four five six seven eight nine ten eleven twelve"
    long_text = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [
        (1, words * 4, "a"),
        (1, words * 4, "a"),
        (2, None, "a"),
        (3, "", None),
        (4, " \t\n", "b"),
        (None, words * 4, "b"),
        (None, None, None),
        (6, long_text, "c"),
        (7, "token = abcdef1234567890 under the mit license", "c"),
    ]
    extra = [None, "z", 1, 2, 3, 4, 5, 6, 7, 8, 9]
    schema = f"doc_id bigint, text string, source string, {CLASHING}"
    return spark.createDataFrame([(*r, *extra) for r in rows], schema)
