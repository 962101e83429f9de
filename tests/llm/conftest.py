import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, copies, repeated rows, and a column whose name clashes."""
    prose = " ".join(f"w{i % 97}x{i % 13}" for i in range(120))
    rows = [
        (1, None, None, None, None, 1), (2, "", "en", "src0", 0, 1), (3, prose, "en", "src0", 1, 1), (4, prose, "en", "src1", 1, 1), (5, prose + " tail", "de", "src1", 1, 1),
        (6, "short text", "en", "s", 1, 1), (6, "short text", "en", "s", 1, 1), (7, "é ñ 日本   <|endoftext|>", "fr", "src2", 1, 1), (8, " ".join(f"long{i}" for i in range(30_000)), "en", "src3", 1, 1),
        (9, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose, "en", "src3", 1, 1), (10, "\n\n \t", "en", "src3", 1, 1),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)
