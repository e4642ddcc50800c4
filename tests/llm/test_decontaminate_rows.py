"""Rows are judged one by one, whatever the size of the benchmark."""

import pytest
from pyspark.sql import functions as F

from lagpair.llm import decontaminate

ITEMS = [(1, "alpha beta gamma delta"), (2, "one two three four five"), (3, "red green blue")]
ROWS = [
    (None, "x alpha beta gamma delta y"),
    (None, "nothing here"),
    (7, "one two three four five, red green blue"),
    (7, "a clean row of the same id"),
    (7, "red green blue"),
    (8, None),
]


@pytest.mark.parametrize("bits", [decontaminate.MARK_BITS, 4, 1])
def test_rows_that_share_an_id_or_have_none(spark, documents, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "MARK_BITS", bits)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(ROWS)
    out = decontaminate.contamination(docs, bench)
    assert out.columns[0] == "doc_id" and "lagpair_row" not in out.columns
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in out.collect()), key=repr)
    want = [(None, 6, 4, 1, True), (None, 2, 0, 0, False), (7, 8, 8, 2, True), (7, 7, 0, 0, False), (7, 3, 3, 1, True), (8, 0, 0, 0, False)]
    assert got == sorted(want, key=repr)
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=repr) == sorted([ROWS[1], ROWS[3], ROWS[5]], key=repr)


def test_runs_are_the_same_at_every_size_of_the_bitmap(spark, documents, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [*ROWS, (9, "one two three four five red green blue x one two three four five")]
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_starts", "hit_ends"]
    def found():
        return sorted((tuple(r) for r in decontaminate.contamination(documents(rows), bench).select(*map(F.col, columns)).collect()), key=repr)

    whole = found()
    assert [r[7:] for r in whole if r[0] == 9] == [([0, 9], [8, 14])]
    monkeypatch.setattr(decontaminate, "MARK_BITS", 1)
    assert found() == whole


def test_a_long_text_that_repeats_a_passage(spark, documents):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    text = " ".join(["one two three four five six seven eight nine ten eleven", *["pad"] * 30] * 3000)
    got = decontaminate.contamination(documents([(1, text)]), bench).first()
    assert (got["n_words"], got["n_hit"], got["n_items"], len(got["hit_starts"])) == (41 * 3000, 11 * 3000, 1, 3000)
