import random

import corpus_pipeline as P

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(k, n=60):
    rng = random.Random(k)
    return " ".join(f"w{rng.randrange(9973):x}" for _ in range(n))


def test_stages_on_a_small_corpus(spark, tmp_path):
    en, de = "the quick brown fox and the lazy dog were there with them ", "der schnelle braune fuchs und der faule hund waren dort mit ihnen "
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(k, (en if k % 2 else de) * 3 + words(k), "en" if k % 2 else "de", "s") for k in range(40)]
    rows += [(100, "12345 67890 !!!", None, None), (101, None, None, None), (102, "", "en", "s")]
    rows += [(200, rows[1][1] + " tail", "en", "s"), (201, rows[1][1], "en", "s"), (202, en * 2 + words(202) + " " + item + " end", "en", "s")]
    rows += [(203, en * 2 + words(203) + ' password = "hunter2hunter2" x', "en", "s"), (None, en + words(300), "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, kept, str(tmp_path))
        if name != "packing":
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r["doc_id"] for r in kept.collect()]
    clean = set(range(40)) | {203, None}
    assert set(seen["language_id"]) == clean | {200, 201, 202}
    assert set(seen["near_dedup"]) == clean | {202}
    assert set(seen["decontaminate"]) == clean == set(seen["secrets"]) == set(seen["packing"])
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in spark.read.parquet(f"{tmp_path}/secrets").collect()}
    assert "hunter2" not in texts[203][0] and "[secret]" in texts[203][0] and texts[203][1] == len(texts[203][0])
    assert texts[3][0] == rows[3][1]


def test_run_on_the_table(spark, sf_dir):
    out = P.run(spark, sf_dir).collect()
    assert out and len({(r["doc_id"], r["piece"]) for r in out}) == len(out)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
