import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, ids string, row string, bucket int, label string, target string, n int, found string, kind string, position int"


def documents(spark, rows):
    """Documents with extra columns whose names operators also use."""
    full = [(i, t, lang, source, len(t or ""), 1, "i", "r", 2, "l", "t", 3, "f", "k", 4) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


PASSAGE = " ".join(f"passage{i}word" for i in range(55))
WORDS = " ".join(f"w{i % 97}x{i % 89}" for i in range(400))


@pytest.fixture(scope="session")
def odd_rows():
    return [
        (1, None, "en", "a"),
        (2, "", "en", None),
        (None, "no id here at all " * 5, None, "a"),
        (3, WORDS, "en", "b"),
        (4, WORDS, "en", "b"),
        (4, WORDS, "en", "b"),
        (5, WORDS.replace("w5x5", "other"), "de", None),
        (6, "long " * 50_000, "en", "a"),
        (7, f"head of one {PASSAGE} tail of one", "en", "c"),
        (8, f"quite another start {PASSAGE} and end", "en", "c"),
        (9, " \t\n ", "fr", "c"),
        (10, "mail ann.b@mail.example.com or +1 (555) 123-4567 é <s>[INST]", "en", "d"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return documents(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 1, 0), (4, 0, 0), (6, 0, 0), (None, 1, 0), (99, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def texts(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
