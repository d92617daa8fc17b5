import pytest

WORDS = "the of and to in that is with for by as on at be this are from or an it".split()


def prose(rng, n: int, extra: int = 400) -> str:
    """n words, some frequent, most of them invented."""
    return " ".join(rng.choice(WORDS) if rng.random() < 0.4 else f"w{rng.randrange(extra)}" for _ in range(n))


def edited(rng, text: str, share: float) -> str:
    words = text.split()
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with names that operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "a b c d e f\nsame line\nx", "en", "s", 9),
        (1, "a b c d e f\nsame line\nx", "en", "s", 9),
        (2, "", None, None, None),
        (3, None, None, None, None),
        (None, None, None, None, None),
        (None, "a b c d e f\nsame line\nx", None, "s", 9),
        (4, long, "en", "s", 1),
        (5, "\n\n  \n", "en", None, 1),
        (6, "é ß \U0001f600", "de", "t", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.selectExpr("*", "1 AS shard", "'z' AS score", "2 AS size", "3 AS slot", "4 AS n_dropped", "5 AS class", "6 AS key", "7 AS id", "8 AS name")


@pytest.fixture
def no_documents(odd_documents):
    return odd_documents.limit(0)
