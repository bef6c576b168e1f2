import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text) as a table with the other columns of documents and some that clash with inner names."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, row string, name string, idx string, tokens string"
        full = [(d, t, None, None, None, "x", None, "i", "k") for d, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def store(tmp_path_factory):
    """Writes a documents table to a folder that a query can read."""

    def put(df, **others):
        folder = tmp_path_factory.mktemp("tables")
        for name, table in {"documents": df, **others}.items():
            table.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return put
