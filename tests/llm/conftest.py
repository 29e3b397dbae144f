import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASHES = ["s", "block", "key", "node", "its", "digest", "words", "size", "text_key", "lang_pred", "quality_score", "label", "component_id", "keep_id", "part", "dropped_id", "hit_id", "mix_doc_id", "mix_words", "dropped_digest", "other", "statistics"]


@pytest.fixture(scope="session")
def rows(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.fixture(scope="session")
def odd_rows(rows):
    """Null and empty texts, null ids, languages and sources, ties, repeated rows, a very long text."""
    long_text = " ".join(t for _, t, *_ in rows[:60] if t) * 3
    return [
        *rows[:40], (9001, None, "en", "a", 0), (9002, "", None, None, 0), (9003, " \n ", "en", "b", 3), (None, rows[3][1], "en", None, 5), (None, "alone and without an id", None, "b", 5),
        (9004, "...!?", "en", "c", 5), (9005, "one two", "en", "c", 7), (9006, "ONE two", "en", "c", 7), rows[5], (9007, long_text, "en", "z", None), (9008, rows[7][1], "fr", "z", None), (9009, "ü", "de", "z", 1),
    ]


@pytest.fixture
def frame(spark):
    def make(data, clashing=False):
        df = spark.createDataFrame(data, DOCS)
        for c in CLASHES if clashing else []:
            df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make
