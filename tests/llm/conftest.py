import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table; missing columns are null, extra ones come last."""
    def make(rows, extra=""):
        width = len(DOCUMENTS.split(",")) + (len(extra.split(",")) if extra else 0)
        filled = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        return spark.createDataFrame(filled, DOCUMENTS + (f", {extra}" if extra else ""))

    return make


@pytest.fixture(scope="session")
def long_text():
    """Two hundred thousand words without repetition."""
    return " ".join(f"w{i}" for i in range(200_000))


# Columns whose names the operators use inside.
CLASHING = (
    "node bigint, size bigint, mark string, token string, component string, start string, words string, shard string, "
    "_doc string, _mark string, _text string, _key string, _source string, _copy string, copies string, passages string, hashes string")
