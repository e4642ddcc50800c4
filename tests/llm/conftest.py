import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang, source), with columns that clash with the operators' own."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] else 0) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if not extra:
            return df
        from pyspark.sql import functions as F

        clash = ["n", "key", "node", "score", "rank", "length", "h", "n_words", "component_id", "kept", "content_key", "start", "size", "toxic", "row_number", "mark_at", "mark_of", "mark_all", "mark_word", "window", "token"]
        return df.select("*", *(F.lit("x").alias(c) for c in clash))

    return make
