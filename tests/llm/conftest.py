import pytest

from ..conftest import DATA, duck, spark  # noqa: F401


@pytest.fixture(scope="session")
def documents(spark):  # noqa: F811
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):  # noqa: F811
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with names that results use."""
    long = "word and another thing. " * 9000
    texts = [None, "", "", "   ", "!!!", "The quick brown fox jumps over the lazy dog.", "The quick brown fox jumps over the lazy dog.", long, long + "x", "ÀÉ 漢字 🎉 \u0000 end", "MIT License", None]
    rows = [(i, t, "en" if i % 2 else None, None, len(t) if t else None, 0.5, True, i, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5]]  # repeated rows
    rows += [(None, "no id here at all", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, shard long, labels string, class_id string")
