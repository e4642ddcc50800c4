"""The pipeline's language stage drops what is in no language and keeps what cannot be judged."""

import random

import corpus_pipeline as P

SENTENCES = [
    "Сегодня утром мы пошли на рынок и купили свежий хлеб, молоко и немного сыра для завтрака.",
    "Dzisiaj rano poszliśmy na targ i kupiliśmy świeży chleb, mleko oraz trochę sera na śniadanie.",
    "Tänä aamuna menimme torille ja ostimme tuoretta leipää, maitoa ja vähän juustoa aamiaiseksi.",
]
SHORT = ["A.\nAll rights reserved.", "Avec.", "Osiebo | armici.", "the"]


def noise(letters, words, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(words))


def test_foreign_scripts_and_gibberish_go_and_short_texts_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    foreign = SENTENCES + [noise("абвгдежзийклмнопрстуфхцчшщъыьэюя", 120, k) for k in range(60)] + [noise("abcdefghijklmnopqrstuvwxyz", 120, k) for k in range(60)]
    new = [(1_000_000 + k, t, None, "x", len(t)) for k, t in enumerate(foreign)] + [(2_000_000 + k, t, None, "x", len(t)) for k, t in enumerate(SHORT)]
    rows = docs.unionByName(spark.createDataFrame(new, docs.schema))
    kept = {r["doc_id"] for r in P.identify_language(spark, rows, sf_dir).select("doc_id").collect()}
    lettered = {r["doc_id"] for r in docs.collect() if r["lang"] and any(c.isalpha() for c in r["text"] or "")}
    assert {d for d in kept if d >= 1_000_000} == {2_000_000 + k for k in range(len(SHORT))}
    assert lettered <= kept


def test_nothing_is_rejected_without_labels(spark, documents):
    rows = [(1, "some text", None), (2, "другой текст", None), (3, "123", None), (4, None, None)]
    full = [(d, t, None, "s", 0) for d, t, _ in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in P.identify_language(spark, docs, "").collect()} == {1, 2, 3, 4}


def test_a_language_with_few_texts_rejects_no_new_text_in_it(spark):
    full = [(1, "the quick brown fox and the lazy dog were there with them", "en", "s", 0), (2, "there was another dog in the garden and it barked at all of us that day", None, "s", 0)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in P.identify_language(spark, docs, "").collect()} == {1, 2}
