import pytest

SCHEMA = "doc_id long, text string, source string, n long, component string, id string, mix int, doc int, key string, size string, step string, part int"

WORDS = "one two three four five six seven eight nine ten eleven twelve"


def rows(texts):
    """Documents with extra columns whose names the operators use themselves."""
    return [(i, t, s, 7, "c", "i", 1, 2, "k", "z", "s", 3) for i, t, s in texts]


EDGES = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, WORDS, "a"), (5, WORDS.upper(), "b"), (6, WORDS + " thirteen", "b"),
    (7, "solo", "c"), (8, "SOLO ", "c"), (9, "naïve café 😀 line here\nshared line of text\n\nshared line of text", "d"),
    (10, "other\nshared line of text", None), (11, "shared line of text", "d"), (12, "x " * 40_000, "e"), (12, "x " * 40_000, "e"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing column names."""
    return spark.createDataFrame(rows(EDGES), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
