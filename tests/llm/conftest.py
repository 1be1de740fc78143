import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def table(spark):
    """A documents table of the given texts; ids count from 0, sources alternate. Extra columns have clashing names."""

    def make(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = langs or ["en"] * len(texts)
        rows = [(i, t, lang, f"s{k % 2}" if k % 5 else None, None if t is None else len(t)) for k, (i, t, lang) in enumerate(zip(ids, texts, langs))]
        df = spark.createDataFrame(rows, SCHEMA)
        for c in ("id", "t", "row", "at", "n", "h", "copy", "fp", "score", "pieces"):
            df = df.withColumn(c, df["doc_id"])
        return df

    return make


@pytest.fixture
def odd():
    """Nulls, empty and blank texts, repeats, one of many words, characters of all lengths."""
    long = " ".join(f"word{i % 97}x{i // 7}" for i in range(6000))
    return [None, "", "   \n\t", "a", "one two three", "one two three", long, long + " end", "é ñ 漢字 😀 ▁ x", "a\x00b\nc", "...!!!"]
