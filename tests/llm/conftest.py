import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from ``(doc_id, text)`` or whole rows, with columns that clash with the operators' own."""

    def make(rows, extra=True):
        full = [(*r, *(None, None, None)[: 5 - len(r)]) if len(r) < 5 else r for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("fp", "size", "shard", "kept", "label", "token", "uid", "copy", "n", "weight"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make
