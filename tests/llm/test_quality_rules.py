import random
import re

from lagpair.llm import quality_rules as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def rows_of(df):
    return {r["doc_id"]: tuple(r[c] for c in Q.BASE) for r in df.collect()}


def test_statistics_against_brute_force(spark, documents):
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "a"), (4, "a b c d e f g"), (5, "a b c d e f g h"), (6, "a " * 9), (7, "x y  z \x85q \x1fr"), (8, "l 1\nl 1\r\n\n\nl 1\nl 1\r\n")]
    rows += [(10 + k, rng.choice([" ", "\n", "  "]).join(rng.choice(["a", "b", "ünï", "日本", "#$", "|", "c\n"]) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    block = " ".join(f"w{k}" for k in range(500))
    rows += [(900, f"{block} mid {block} {block}"), (901, "same " * 3000), (902, "\U0001f600 *" * 30)]
    assert rows_of(Q.statistics(documents(rows))) == {d: brute(t) for d, t in rows}
    assert Q.statistics(documents([])).count() == 0


def test_learns_an_ordered_list():
    rng = random.Random(8)
    rows = []
    for k in range(3000):
        r = {n: rng.random() for n in Q.RATIOS}
        r["bad"] = (r["symbols_per_word"] > 0.8 and r["upper_share"] <= 0.5) or r["dup_line_share"] > 0.9
        r["grown"] = k % 3 > 0
        rows.append(r)
    rules = Q.learn(rows)
    assert 2 <= len(rules.rules) <= 6
    wrong = sum(any(all(c.holds(r) for c in rule) for rule in rules.rules) != r["bad"] for r in rows)
    assert wrong < 0.03 * len(rows)
    assert all(line.startswith("reject if ") for line in rules.describe())


def test_no_labels_keep_all_that_pass(spark, documents):
    labels = spark.createDataFrame([(1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    text = " ".join(f"w{k}" for k in range(30))
    out = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in Q.judged(documents([(1, text), (2, "few words"), (3, "ab " * 50), (None, text)]), labels).collect()}
    assert out == {1: (False, True), 2: (True, False), 3: (True, False), None: (False, True)}
    assert Q.judged(documents([]), labels).count() == 0


def test_query_on_the_table(spark, sf_dir):
    from lagpair.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = QUERIES["op3_quality_rules"](spark, sf_dir)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        base = brute(docs.pop(r["doc_id"]))
        assert tuple(r[c] for c in Q.BASE) == base
        assert r["base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r["base_failed"] and r["kept"])
    assert not docs


def test_rows_that_the_rules_were_not_learnt_from(spark):
    """Rules of one half of the labelled rows, judged on the other half."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    out = Q.judged(spark.read.parquet(f"{sf}/documents.parquet"), labels.where(half == 0)).join(labels.where(half == 1).select("doc_id", "quality"), "doc_id").collect()
    bad, good = [r for r in out if r["quality"] == 0], [r for r in out if r["quality"] == 1 and not r["base_failed"]]
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
