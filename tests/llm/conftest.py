import pytest

SF = "/root/testdata/sf0.001"
EXTRA = "sketch string, tie bigint, bands string, n_lines int, score double"


@pytest.fixture(scope="session")
def real(spark):
    """The smallest driver table."""
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and wordless texts, repeated rows and ids, a long text, and columns with clashing names."""
    long = " ".join(f"w{i % 977} and{i}" for i in range(30_000))
    rows = [
        (5, "Aé ß! one two three four five six seven\nline two of it 12", "en", "s", 7), (5, "Aé ß! one two three four five six seven\nline two of it 12", "en", "s", 7), (5, "other text under one id", None, None, None),
        (None, "no id here but words enough to count", "en", None, 3), (None, None, None, None, None), (1, "", "de", "s", 0), (2, None, "de", "t", None), (3, "... !!! 123", "fr", "t", 5), (-4, "x", "fr", "u", 1),
        (10**15, long, "en", "u", len(long)), (11, "日本語 <|endoftext|> it's İ Σας", "xx", "u", 1),
    ]
    extra = ("a", 1, "b", 2, 0.5)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id = 424242")
