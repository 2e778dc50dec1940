import pytest

LONG = "sehr lang und immer weiter " * 8000
TEXTS = [
    "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau.\nSecond line of the text here.\nThird line, and more of it!",
    "", None, " \n\t ", "...!!! 123 456", "one", "two words", "five little words right here", "ßäöü ñandú — çedille 日本語 🙂 x", LONG, LONG + "end", "a" * 3000, "ab " * 500,
    "tie", "tie", "x\r\ny\x1cz\x85w", "İSTANBUL ΟΔΟΣ don't WE'LL", "<|endoftext|> plain",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, long and repeated texts, ties, a null key, and columns whose names operators use."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no key here at all"), (13, "tie")]
    rows = [(*r, "en", "s", 0, 0.5, "f", 7, [1], "c", "k") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, length long, ids array<int>, component_id string, kept string").cache()


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
