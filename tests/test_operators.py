import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagpair.functions import sessions, vectors
from lagpair.operators import attention, folds, metrics, pairs, sampling, signals, training
from lagpair.operators.ranking import ranked, tile

D = dt.date


def visits(spark, rows):
    return spark.createDataFrame(rows, "id string, d date")


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "group_name string")


def test_names_that_do_not_parse(spark):
    df = names(spark, ["7_2024_01_02_x", "7_2024_01_02_x", "007_2024_01_02", "bad", "9_2024_13_45_x", None, "_2024_01_02"])
    got = {(r["id"], r["d"]) for r in pairs.sessions(df).collect()}
    assert got == {("7", D(2024, 1, 2)), ("007", D(2024, 1, 2))}
    assert {r[0] for r in pairs.rejected(df).collect()} == {"bad", "9_2024_13_45_x", None, "_2024_01_02"}
    for bad in ("bad", "9_2024_13_45_x"):
        with pytest.raises(Exception):
            pairs.sessions(names(spark, [bad]), mode="strict").collect()
    with pytest.raises(ValueError):
        sessions.split_part(F.lit("a"), 0, "other")


def test_consecutive_pairs(spark):
    rows = [("a", D(2024, 1, 1)), ("a", D(2024, 1, 31)), ("a", D(2024, 5, 1)), ("b", D(2024, 1, 1)), ("c", D(2024, 2, 2)), ("c", D(2024, 2, 2)), (None, D(2024, 1, 1)), ("d", None)]
    got = sorted(map(tuple, pairs.consecutive(visits(spark, rows)).collect()))
    assert got == [("a", D(2024, 1, 1), D(2024, 1, 31), 30), ("a", D(2024, 1, 31), D(2024, 5, 1), 91), ("c", D(2024, 2, 2), D(2024, 2, 2), 0)]
    assert pairs.consecutive(visits(spark, rows), min_gap_days=1).count() == 2
    assert pairs.consecutive(visits(spark, [])).count() == 0


def test_one_subject_over_many_months(spark):
    days = [D(2020, 1, 1) + dt.timedelta(days=(k * 37) % 1500) for k in range(300)]
    got = sorted((r["before"], r["after"]) for r in pairs.consecutive(visits(spark, [("x", d) for d in days])).collect())
    days.sort()
    assert got == list(zip(days, days[1:]))


def test_string_order_of_ids(spark):
    assert [r[0] for r in names(spark, ["9", "99", "100"]).orderBy("group_name").collect()] == ["100", "9", "99"]


def test_validity(spark):
    p = spark.createDataFrame([("a", D(2024, 1, 1), D(2024, 1, 2)), ("a", D(2024, 1, 1), D(2024, 1, 2)), ("a", D(2024, 1, 2), D(2024, 1, 3))], "id string, before date, after date")
    index = spark.createDataFrame([("a", D(2024, 1, 1), 0), ("a", D(2024, 1, 2), 1), ("a", D(2024, 1, 2), 2)], "id string, d date, idx long")
    assert pairs.valid(p, index).count() == 2 and pairs.invalid(p, index).count() == 1
    assert {r["d"]: r["idxs"] for r in pairs.date_index(index).collect()} == {D(2024, 1, 1): [0], D(2024, 1, 2): [1, 2]}
    ex = sampling.examples(pairs.valid(p, index).distinct(), pairs.instances(index), 20)
    got = ex.collect()
    assert len(got) == 20 and {r["i0"] for r in got} == {0} and {r["i1"] for r in got} == {1, 2} and {r["label"] for r in got} == {0, 1}
    swapped = sampling.ordered(ex).collect()
    assert all((r["idx_1"] == 0) == (r["label"] == 0) for r in swapped)
    again = sampling.examples(pairs.valid(p, index).distinct(), pairs.instances(index), 20, epoch=1).collect()
    assert sorted(map(tuple, again)) != sorted(map(tuple, got))


def test_folds(spark):
    ids = spark.createDataFrame([(str(k),) for k in range(13)] + [("3",), (None,)], "id string")
    got = folds.fold_map(ids, 5).collect()
    sizes = np.bincount([r["fold"] for r in got], minlength=6)[1:]
    assert sizes.tolist() == [3, 3, 3, 2, 2] and len({r["id"] for r in got}) == 13
    few = folds.fold_map(ids.where("id in ('1', '2')"), 5).collect()
    assert sorted(r["fold"] for r in few) == [1, 2]
    order = np.array(sorted(str(k) for k in range(13)), dtype=object)
    np.random.RandomState(42).shuffle(order)
    assert {r["id"]: r["fold"] for r in folds.exact_fold_map(ids, 5).collect()} == {i: n for n, part in enumerate(np.array_split(order, 5), 1) for i in part}
    folded = folds.fold_map(ids, 3)
    train, test = folds.split(folded, 2)
    assert not {r["id"] for r in train.collect()} & {r["id"] for r in test.collect()} and train.count() + test.count() == 13
    with pytest.raises(ValueError):
        folds.split(folded, 9)
    with pytest.raises(ValueError):
        folds.split(folds.fold_map(ids, 1), 1)
    halves = folds.group_shuffle_split(ids, 0.6).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in halves} == {"train": 7, "test": 6}


def test_ranks_and_tiles(spark):
    df = spark.createDataFrame([(k % 3, (k * 7) % 100) for k in range(100)] + [(None, 1), (None, 0)], "g int, x int")
    got = ranked(df, ["x"], ("g",), size="n").collect()
    for g in (0, 1, 2, None):
        mine = sorted((r["x"], r["rank"]) for r in got if r["g"] == g)
        assert [r for _, r in mine] == list(range(len(mine))) and {r["n"] for r in got if r["g"] == g} == {len(mine)}
    hot = ranked(spark.range(50_000).selectExpr("'one' as g", "id * 7919 % 50021 as x"), ["x"], ("g",)).collect()
    assert [r["rank"] for r in sorted(hot, key=lambda r: r["x"])] == list(range(50_000))
    assert sorted(r["rank"] for r in ranked(spark.range(1000), ["id"]).collect()) == list(range(1000)) and ranked(spark.range(0), ["id"]).count() == 0
    tiles = spark.range(7).select(tile(F.col("id"), F.lit(7).cast("long"), 3).alias("t")).collect()
    assert [r["t"] for r in tiles] == [1, 1, 1, 2, 2, 3, 3]


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 32)), rng.normal(size=(5, 32))
    df = spark.createDataFrame([(k, x[k].tolist(), y[k].tolist()) for k in range(5)], "k int, x array<double>, y array<double>")
    toks = lambda c: vectors.tokens(F.col(c), 8)
    out = df.select("k", *(vectors.pool(toks("x"), p).alias(p) for p in ("mean", "max", "concat")), vectors.delta(F.col("x"), F.col("y")).alias("d"), vectors.delta(F.col("y"), F.col("x")).alias("back")).orderBy("k").collect()
    for k, r in enumerate(out):
        t = x[k].reshape(4, 8)
        assert np.allclose(r["mean"], t.mean(0)) and np.allclose(r["max"], t.max(0)) and np.allclose(r["concat"], x[k])
        assert np.allclose(r["d"], y[k] - x[k]) and np.allclose(r["back"], -np.array(r["d"]))
    with pytest.raises(ValueError):
        vectors.pool(F.lit(1), "median")
    z = spark.createDataFrame([([1.0, 3.0, 3.0], 2)], "z array<double>, y int").select(vectors.softmax(F.col("z")).alias("p"), vectors.argmax(F.col("z")).alias("a"), vectors.cross_entropy(F.col("z"), F.col("y")).alias("ce")).first()
    e = np.exp([1, 3, 3]) / np.exp([1, 3, 3]).sum()
    assert np.allclose(z["p"], e) and z["a"] == 1 and math.isclose(z["ce"], -math.log(e[2]))
    w = [0.5] * 8
    g = np.array(vectors.mean_pool_gradient(w, 4))
    assert np.allclose(g.ravel() @ x[0], np.dot(w, x[0].reshape(4, 8).mean(0)))


def test_attention_against_loops(spark):
    m = attention.AttentivePool.fixed(6, 8, heads=2)
    x = np.random.default_rng(1).normal(size=(3, 5, 6))
    w = m.weights
    for r in range(3):
        t = x[r] @ w["project"].T
        q, k, v = w["query"][0] @ w["wq"].T + w["bq"], t @ w["wk"].T + w["bk"], t @ w["wv"].T + w["bv"]
        heads = []
        for h in range(2):
            s = slice(4 * h, 4 * h + 4)
            a = np.exp(k[:, s] @ q[s] / 2.0)
            heads.append((a / a.sum()) @ v[:, s])
        o = np.concatenate(heads) @ w["wo"].T + w["bo"]
        u = o @ w["up"].T + w["up_b"]
        u = np.array([z * 0.5 * (1 + math.erf(z / math.sqrt(2))) for z in u])
        assert np.allclose(m(x)[r], u @ w["down"].T + w["down_b"])
    df = spark.createDataFrame([(0, x[0].ravel().tolist()), (1, None), (2, [1.0])], "k int, x array<double>")
    got = {r["k"]: r["v"] for r in df.select("k", m.pooled(F.col("x")).alias("v")).collect()}
    assert np.allclose(got[0], m(x)[0]) and got[1] is None and got[2] is None
    with pytest.raises(ValueError):
        attention.AttentivePool.fixed(8, 6, heads=4)


def test_attentive_gradient_against_differences(spark):
    for dims in ((6, 8), (8, 8)):
        m = attention.AttentivePool.fixed(*dims, heads=2)
        rng = np.random.default_rng(4)
        x, w = rng.normal(size=(2, 3, dims[0])), rng.normal(size=8)
        got = m.gradient(x, w)
        for place in np.ndindex(x.shape):
            up, down = x.copy(), x.copy()
            up[place] += 1e-5
            down[place] -= 1e-5
            assert math.isclose(got[place], (m(up) @ w - m(down) @ w)[place[0]] / 2e-5, rel_tol=1e-4, abs_tol=1e-8)
    df = spark.createDataFrame([(0, x[0].ravel().tolist()), (1, None)], "k int, x array<double>")
    rows = {r["k"]: r for r in df.select("k", m.saliency(F.col("x"), w.tolist()).alias("g"), m.saliency(F.col("x"), w.tolist(), before=True).alias("h")).collect()}
    assert np.allclose(rows[0]["g"], got[0].ravel()) and np.allclose(rows[0]["h"], -got[0].ravel()) and rows[1]["g"] is None


def test_mlp_training(spark):
    model, rng = training.MlpModel(3), np.random.default_rng(7)
    x, y = rng.normal(size=(6, 3)), np.array([0.0, 1, 1, 0, 1, 0])
    w = model.start(1)
    _, g = model.loss(w, x, y)
    for k in range(len(w)):
        up, down = w.copy(), w.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert math.isclose(g[k], (model.loss(up, x, y)[0] - model.loss(down, x, y)[0]) / 2e-6, rel_tol=1e-4, abs_tol=1e-6)
    x = rng.uniform(-1, 1, size=(400, 2))
    rows = [(v.tolist(), int(v[0] * v[1] > 0)) for v in x] + [(None, 1), ([0.0, 0.0], None)]  # no line parts the classes
    df = spark.createDataFrame(rows, "x array<double>, label int").repartition(2)
    w, losses = training.AdamW(rate=0.2, batches=2).fit(df, 60, "mlp")
    z = training.MlpModel(2).head(w)(x)
    assert losses[-1] < 0.5 * losses[0] and np.mean((z[:, 1] > z[:, 0]) == (x[:, 0] * x[:, 1] > 0)) > 0.9
    with pytest.raises(ValueError):
        training.AdamW().fit(df, 1, "tree")
    with pytest.raises(ValueError):
        training.AdamW().fit(df.limit(0), 1)


def test_mlp_head_against_loops(spark):
    head = attention.MlpHead.fixed(3)
    x = np.random.default_rng(2).normal(size=(4, 3))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9, None), (10, [1.0])]
    got = {r["k"]: r["z"] for r in spark.createDataFrame(rows, "k int, x array<double>").select("k", head.logits(F.col("x")).alias("z")).collect()}
    for k in range(4):
        u = [sum(head.hidden[i][j] * x[k][j] for j in range(3)) + head.hidden_b[i] for i in range(6)]
        u = [z * 0.5 * (1 + math.erf(z / math.sqrt(2))) for z in u]
        assert np.allclose(got[k], [sum(head.out[c][i] * u[i] for i in range(6)) + head.out_b[c] for c in range(2)])
    assert got[9] is None and got[10] is None


def test_train_test_batches(spark):
    visits = [(str(s), D(2024, 1, 1) + dt.timedelta(days=d), 10 * s + d) for s in range(12) for d in range(4)]
    index = spark.createDataFrame(visits, "id string, d date, idx long")
    found = pairs.consecutive(index.select("id", "d"))
    folded = folds.assign(found, folds.fold_map(found, 3))
    train, test = sampling.train_test_batches(folded, pairs.instances(index), 1, n_draws=2, size=7)
    a, b = train.collect(), test.collect()
    assert len(a) == 48 and len(b) == 24 and not {r["id"] for r in a} & {r["id"] for r in b}
    assert sorted(r["batch_id"] for r in a) == [k // 7 for k in range(48)] and sorted(r["batch_id"] for r in b) == [k // 7 for k in range(24)]
    key = lambda rows: sorted((r["id"], r["before"], r["draw"], r["i0"], r["i1"]) for r in rows)
    assert key(sampling.train_test_batches(folded, pairs.instances(index), 1, 2, 7, epoch=5)[1].collect()) == key(b)
    with pytest.raises(ValueError):
        sampling.train_test_batches(folded, pairs.instances(index), 9)


def auc_by_pairs(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auroc(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(0, 40)) / 40, int(rng.random() < 0.3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "s double, y int")
    got = metrics.auroc(df, "s", "y").first()
    assert math.isclose(got["auc"], auc_by_pairs(rows)) and not got["one_class"]
    other = metrics.auroc(df.select((1 - F.col("s")).alias("s"), "y"), "s", "y").first()
    assert math.isclose(got["auc"] + other["auc"], 1.0)
    for one in (df.where("y = 1"), df.where("y = 5")):
        r = metrics.auroc(one, "s", "y").first()
        assert r["auc"] == 0.0 and r["one_class"]
    log = spark.createDataFrame([(1, 0.9), (20, 0.5), (21, 0.7), (22, 0.7), (23, None)], "epoch int, m double")
    assert metrics.best_epoch(log, "m", 20).first()["epoch"] == 21 and metrics.best_epoch(log, "m", 50).count() == 0


def smooth_by_numpy(x, sigma):
    k = np.array(signals.gaussian_kernel(sigma))
    r = len(k) // 2
    n = len(x)
    at = (np.arange(-r, n + r) % (2 * n) + 2 * n) % (2 * n)
    return np.convolve(x[np.where(at < n, at, 2 * n - 1 - at)], k, mode="valid")


@pytest.mark.parametrize("n", [1, 3, 50, 511, 513, 1500])
def test_smoothing(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(c, k, float(v)) for c, s in (("a", x), ("b", np.ones(n))) for k, v in enumerate(s)], "ch string, t long, v double")
    got = {c: [r["v"] for r in signals.gaussian_smooth(df).where(f"ch = '{c}'").orderBy("t").collect()] for c in "ab"}
    assert np.allclose(got["a"], smooth_by_numpy(x, 10.0)) and np.allclose(got["b"], 1.0)


def test_impulse_keeps_its_sum(spark):
    df = spark.createDataFrame([("a", k, float(k == 0)) for k in range(200)], "ch string, t long, v double")
    assert math.isclose(signals.gaussian_smooth(df).agg(F.sum("v")).first()[0], 1.0)


def test_normalising(spark):
    df = spark.createDataFrame([("a", k, float(k)) for k in range(10)] + [("b", k, 3.0) for k in range(10)], "ch string, t long, v double")
    z = signals.zscore(df).groupBy("ch").agg(F.avg("v").alias("m"), F.max(F.abs("v")).alias("x")).collect()
    assert all(abs(r["m"]) < 1e-9 for r in z) and {r["ch"]: r["x"] for r in z}["b"] == 0
    m = signals.minmax(df).agg(F.min("v"), F.max("v")).first()
    assert m[0] == 0 and 0.99 < m[1] <= 1
    assert signals.minmax(df.where("ch = 'b'")).agg(F.max("v")).first()[0] == 0
    assert signals.patchify(df, 5).where("patch = 1 and pos = 0").count() == 2
    with pytest.raises(Exception):
        signals.patchify(df, 4).collect()
    ranks = signals.channel_ranking(spark.createDataFrame([("x", 1.0, 2.0), ("a", 2.0, 1.0), ("m", 5.0, 0.0)], "ch string, t0 double, t1 double"))
    assert [r["ch"] for r in ranks.orderBy("rank").collect()] == ["m", "a", "x"]
    s = spark.createDataFrame([("g", 0, "c", [1.0, 2.0, 3.0])], "group_name string, pos int, channel string, samples array<float>")
    assert signals.snippet(s, 1, 50).first()["samples"] == [2.0, 3.0]


def test_heads_learn(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] - x[:, 2] > 0).astype(int)
    df = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y)], "x array<double>, label int").repartition(2)
    for kind in training.HEADS:
        out = training.apply_head(training.fit_head(df, kind), df)
        assert out.agg(metrics.accuracy("pred", "label")).first()[0] > 0.9
    a, b, m, v = np.zeros(5), [], np.zeros(5), np.zeros(5)
    z1 = np.column_stack([x, np.ones(len(x))])
    for t in range(1, 9):  # the same steps in numpy
        z = z1 @ a
        b.append(np.mean(np.logaddexp(0, z) - y * z))
        g = z1.T @ (1 / (1 + np.exp(-z)) - y) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        a = a - 0.1 * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + 5e-4 * a)
    w, losses = training.AdamW(rate=0.1).fit(df, 8)
    assert np.allclose(w, a) and np.allclose(losses, b)
    assert losses[-1] < losses[0] and w[0] > 0 > w[2]
    assert training.project(df).columns == ["x", "label", "p0", "p1"]
    values, axes = np.linalg.eigh(np.cov(x.T))
    got = np.array([[r["p0"], r["p1"]] for r in training.project(df).collect()])
    seen = np.array([r["x"] for r in training.project(df).collect()])
    for k in (0, 1):  # components up to their sign
        want = seen @ axes[:, -1 - k]
        assert np.allclose(got[:, k], want, atol=1e-6) or np.allclose(got[:, k], -want, atol=1e-6)
    with pytest.raises(ValueError):
        training.fit_head(df, "tree")
