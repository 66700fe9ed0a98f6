import pytest

_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, size string, target string, whole string, node string, copy string, lang_pred string, score string, component_id string"

LONG = " ".join(f"word{i % 977} thing{i % 31}" for i in range(120_000))


def _rows():
    texts = [
        None, "", "   \n\t", "!!! ... 123", "one", "two words", LONG, LONG, "the same text said twice by two of them today",
        "the same text said twice by two of them today", "é ü ß 日本語 \U0001f600 mixed text", "a\x01b\x02c password = hunter2hunter2",
    ]
    return [(None if i in (2, 4) else i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 4}", 1, *["x"] * 10) for i, t in enumerate(texts)]


@pytest.fixture
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and extra columns that are called like results."""
    rows = _rows()
    return spark.createDataFrame([*rows, rows[5], rows[5], rows[0]], _COLUMNS)


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
