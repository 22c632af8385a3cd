import pytest

#: Extra columns whose names clash with those that operators use inside.
CLASH = ["fp", "key", "id", "bucket", "n_words", "features", "quality", "shard", "length", "width", "h", "token"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text) pairs, with lang, source, n_chars and columns of clashing names."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
        full = [(i, t, None, "s", len(t) if t is not None else None, *["x"] * len(CLASH)) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
