"""Registered queries of the library's own operators, one for each name in the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagpair import schema
from lagpair.functions import sessions, vectors
from lagpair.operators import attention, folds, metrics, pairs, sampling, signals, training
from lagpair.plans import bindings as B
from lagpair.plans.bindings import table
from lagpair.sources import arrays, checkpoints, tables
from lagpair.sources.shared import stored, work_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PATCH = 40


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c) -> F.Column:
    """Rounded to six places, never a negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).cast("double")


def shown(pairs_df: DataFrame, *more: str) -> DataFrame:
    """Pairs with their dates as text."""
    return pairs_df.select("id", sampling.day("before").alias("before_date"), sampling.day("after").alias("after_date"), *more)


# sessions


@query
def parse_group_name(spark, sf_dir):
    n = F.col("group_name")
    return B.order_names(spark, sf_dir).select("group_name", *(sessions.name_part(n, k).alias(c) for k, c in enumerate(("id", "y", "m", "d"), 1)))


@query
def split_group_name(spark, sf_dir):
    n = F.col("group_name")
    return B.order_names(spark, sf_dir).select("group_name", *(sessions.split_part(n, k).alias(c) for k, c in enumerate(("id", "y", "m", "d"))))


@query
def session_date(spark, sf_dir):
    parts = [sessions.name_part(F.col("group_name"), k) for k in (2, 3, 4)]
    return B.order_names(spark, sf_dir).select("group_name", F.date_format(sessions.session_date(*parts), "yyyy-MM-dd").alias("session_date"))


@query
def zero_pad_dates(spark, sf_dir):
    rows = B.order_names(spark, sf_dir)
    return rows.select("group_name", sessions.zero_padded(F.month("d").cast("double")).alias("m_pad"), sessions.zero_padded(F.dayofmonth("d").cast("double")).alias("d_pad"))


@query
def distinct_sessions(spark, sf_dir):
    return pairs.sessions(B.order_names(spark, sf_dir)).select("group_name")


@query
def longitudinal_pairs(spark, sf_dir):
    return pairs.pair_parts(B.order_pairs(spark, sf_dir))


@query
def date_index_collect(spark, sf_dir):
    rows = pairs.date_index(B.event_index(spark, sf_dir))
    idxs = F.col("idxs")
    return rows.select("id", F.date_format("d", "yyyy-MM-dd").alias("date"), F.size(idxs).cast("long").alias("n"), idxs[0].alias("first_idx"), F.element_at(idxs, -1).alias("last_idx"), F.array_join(idxs.cast("array<string>"), ",").alias("idxs"))


@query
def valid_pairs_semi_join(spark, sf_dir):
    return shown(pairs.valid(B.order_pairs(spark, sf_dir), B.finished_orders(spark, sf_dir)))


@query
def invalid_pairs_anti_join(spark, sf_dir):
    return shown(pairs.invalid(B.order_pairs(spark, sf_dir), B.finished_orders(spark, sf_dir)))


@query
def rejected_names(spark, sf_dir):
    """Names of open orders are spoilt: they do not parse."""
    names = B.order_names(spark, sf_dir)
    spoilt = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("x"), "group_name")).otherwise(F.col("group_name"))
    return pairs.rejected(names.select(spoilt.alias("group_name")))


# folds


def folded(spark, sf_dir) -> DataFrame:
    rows = B.event_pairs(spark, sf_dir)
    return folds.assign(rows, folds.fold_map(rows, B.FOLDS, B.SEED))


@query
def fold_ntile(spark, sf_dir):
    return folds.fold_map(B.event_pairs(spark, sf_dir), B.FOLDS, B.SEED)


@query
def fold_assignment(spark, sf_dir):
    return shown(folded(spark, sf_dir), "fold")


@query
def fold_train_test(spark, sf_dir):
    return shown(folded(spark, sf_dir).withColumn("split", folds.split_name(B.TEST_FOLD)), "split")


@query
def union_train_folds(spark, sf_dir):
    return shown(folds.union_folds(folded(spark, sf_dir), [f for f in range(1, B.FOLDS + 1) if f != B.TEST_FOLD]))


@query
def kfold_sizes(spark, sf_dir):
    return folds.fold_sizes(folded(spark, sf_dir), B.FOLDS)


@query
def group_shuffle_split(spark, sf_dir):
    return folds.group_shuffle_split(B.event_pairs(spark, sf_dir), 0.6, B.SEED)


@query
def exact_folds(spark, sf_dir):
    """Folds of the legacy seeded shuffle, counted."""
    return folds.exact_fold_map(B.event_pairs(spark, sf_dir), B.FOLDS, B.SEED).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


# sampling


@query
def epoch_length(spark, sf_dir):
    return sampling.epoch_length(B.event_pairs(spark, sf_dir), B.DRAWS)


@query
def expand_draws(spark, sf_dir):
    return shown(sampling.expand(B.event_pairs(spark, sf_dir), B.DRAWS), "draw")


@query
def draw_index_to_pair(spark, sf_dir):
    numbered = sampling.expand(sampling.numbered(B.event_pairs(spark, sf_dir)), B.DRAWS)
    places = numbered.select((F.col("pair_idx") * B.DRAWS + F.col("draw")).alias("global_idx"))
    return places.select("global_idx", sampling.pair_of(F.col("global_idx"), B.DRAWS).alias("pair_idx"))


@query
def sample_instances(spark, sf_dir):
    return shown(B.event_examples(spark, sf_dir), "draw", "i0", "i1", "label")


@query
def random_label(spark, sf_dir):
    return shown(sampling.labelled(sampling.expand(B.event_pairs(spark, sf_dir), B.DRAWS), B.SEED), "draw", "label")


@query
def order_label_swap(spark, sf_dir):
    return shown(sampling.ordered(B.event_examples(spark, sf_dir)), "draw", "idx_1", "idx_2", "label")


@query
def eval_batches(spark, sf_dir):
    return sampling.batches(B.event_examples(spark, sf_dir), B.BATCH).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query
def epoch_order(spark, sf_dir):
    rows = sampling.labelled(sampling.expand(B.event_pairs(spark, sf_dir), B.DRAWS), B.SEED)
    return shown(sampling.epoch_ranks(rows, [*sampling.PAIR, "draw"], B.SEED, 3), "draw", "place")


@query
def train_test_batches(spark, sf_dir):
    """The loader in one call: fold, index and draws."""
    train, test = sampling.train_test_batches(folded(spark, sf_dir), B.event_instances(spark, sf_dir), B.TEST_FOLD, B.DRAWS, B.BATCH, B.SEED)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return shown(both, "draw", "i0", "i1", "label", "split", "batch_id")


@query
def pair_embedding_lookup(spark, sf_dir):
    rows = sampling.with_vectors(B.event_examples(spark, sf_dir), B.embeddings(spark, sf_dir))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    both = F.aggregate(F.zip_with("x0", "x1", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return shown(rows.select("*", r6(total("x0")).alias("sum_0"), r6(total("x1")).alias("sum_1"), r6(both).alias("dot")), "draw", "sum_0", "sum_1", "dot")


@query
def all_pairs_join(spark, sf_dir):
    rows = B.event_pairs(spark, sf_dir)
    return sampling.all_instance_pairs(rows, B.event_index(spark, sf_dir)).select("id", "idx_before", "idx_after")


# vectors


def pooled(spark, sf_dir, kind: str, place: str = "dim") -> DataFrame:
    toks = vectors.tokens(F.col("embedding"), B.TOKEN_DIM)
    rows = B.embeddings(spark, sf_dir).select(F.col("dataset_idx").alias("vec_id"), F.posexplode(vectors.pool(toks, kind)).alias(place, "v"))
    return rows.select("vec_id", F.col(place).cast("long").alias(place), r6(F.col("v")).alias("v"))


@query
def pool_mean(spark, sf_dir):
    return pooled(spark, sf_dir, "mean")


@query
def pool_max(spark, sf_dir):
    return pooled(spark, sf_dir, "max")


@query
def pool_concat(spark, sf_dir):
    return pooled(spark, sf_dir, "concat", "pos")


def long_delta(rows: DataFrame, column, *more: str) -> DataFrame:
    exploded = shown(rows.withColumn("x", column), *more, "x").select("id", "before_date", "after_date", *more, F.posexplode("x").alias("dim", "v"))
    return exploded.withColumns({"dim": F.col("dim").cast("long"), "v": r6(F.col("v"))})


@query
def delta_raw(spark, sf_dir):
    return long_delta(B.vector_pairs(spark, sf_dir), vectors.delta(F.col("x0"), F.col("x1")), "draw")


def mean_pooled(embedding: F.Column) -> F.Column:
    return vectors.pool(vectors.tokens(embedding, B.TOKEN_DIM), "mean")


@query
def delta_mean(spark, sf_dir):
    return long_delta(B.vector_pairs(spark, sf_dir, mean_pooled), vectors.delta(F.col("x0"), F.col("x1")), "draw")


@query
def extract_delta_embeddings(spark, sf_dir):
    rows = B.vector_pairs(spark, sf_dir, mean_pooled)
    flipped = F.col("label") == 1
    signed = F.transform(vectors.delta(F.col("x0"), F.col("x1")), lambda v: F.when(flipped, -v).otherwise(v))
    return long_delta(rows, signed, "draw", "label")


@query
def pool_attentive(spark, sf_dir):
    model = attention.AttentivePool.fixed(B.TOKEN_DIM, B.TOKEN_DIM, heads=2)
    rows = B.embeddings(spark, sf_dir).select(F.col("dataset_idx").alias("vec_id"), F.posexplode(model.pooled(F.col("embedding"))).alias("dim", "v"))
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), r6(F.col("v")).alias("v"))


@query
def delta_attentive(spark, sf_dir):
    model = attention.AttentivePool.fixed(B.TOKEN_DIM, B.TOKEN_DIM, heads=2)
    return long_delta(B.vector_pairs(spark, sf_dir, model.pooled), vectors.delta(F.col("x0"), F.col("x1")), "draw")


@query
def repeat_group_ids(spark, sf_dir):
    groups = sampling.group_ids(B.embeddings(spark, sf_dir).select(F.col("dataset_idx").alias("pos"))).where("pos % 4 = 0")
    return sampling.repeat_ids(groups).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query
def subset_by_index(spark, sf_dir):
    drawn = B.event_examples(spark, sf_dir).select(F.col("i0").alias("dataset_idx")).distinct()
    return B.embeddings(spark, sf_dir).join(drawn, "dataset_idx", "left_semi").select(F.col("dataset_idx").alias("vec_id"))


@query
def project_deltas(spark, sf_dir):
    rows = B.vector_pairs(spark, sf_dir).select("id", "before", "after", "draw", "label", vectors.delta(F.col("x0"), F.col("x1")).alias("x"))
    return shown(training.project(rows), "draw", "label", "p0", "p1")


@query
def train_linear_head(spark, sf_dir):
    """Learns the order of visits from swapped deltas of the training folds and scores the test fold."""
    rows = B.vector_pairs(spark, sf_dir)
    flipped = F.col("label") == 1
    x = F.transform(vectors.delta(F.col("x0"), F.col("x1")), lambda v: F.when(flipped, -v).otherwise(v))
    data = stored(rows.select("id", "label", x.alias("x")).join(folds.fold_map(B.event_pairs(spark, sf_dir), B.FOLDS, B.SEED), "id"), "deltas")
    train, test = folds.split(data, B.TEST_FOLD)
    scored = training.apply_head(training.fit_head(train), test)
    auc = metrics.auroc(scored, "p1", "label").select("auc")
    return scored.agg(F.count(F.lit(1)).alias("n"), metrics.accuracy("pred", "label").alias("acc")).crossJoin(F.broadcast(auc))


@query
def train_mlp_head(spark, sf_dir):
    """The GELU head by AdamW on deltas of the training folds, a fourth of them a step; loss and accuracy on the test fold."""
    rows = B.vector_pairs(spark, sf_dir, mean_pooled)
    flipped = F.col("label") == 1
    x = F.transform(vectors.delta(F.col("x0"), F.col("x1")), lambda v: F.when(flipped, -v).otherwise(v))
    data = stored(rows.select("id", "label", x.alias("x")).join(folds.fold_map(B.event_pairs(spark, sf_dir), B.FOLDS, B.SEED), "id"), "deltas")
    train, test = folds.split(data, B.TEST_FOLD)
    w, _ = training.AdamW(rate=0.01, batches=4).fit(train, 8, "mlp")
    z = training.MlpModel(B.TOKEN_DIM).head(w).logits(F.col("x"))
    scored = test.select("label", z.alias("z")).select("label", vectors.argmax(F.col("z")).alias("pred"), vectors.cross_entropy(F.col("z"), F.col("label")).alias("ce"))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg("ce").alias("loss"), metrics.accuracy("pred", "label").alias("acc"))


@query
def saliency_attentive(spark, sf_dir):
    """Gradient of the first class's logit by each number of a vector of the after side: attentive pool and linear head."""
    model = attention.AttentivePool.fixed(B.TOKEN_DIM, B.TOKEN_DIM, heads=2)
    g = model.saliency(F.col("embedding"), B.WEIGHTS[0][: B.TOKEN_DIM])
    rows = B.embeddings(spark, sf_dir).select(F.col("dataset_idx").alias("vec_id"), F.posexplode(g).alias("pos", "v"))
    return rows.select("vec_id", F.floor(F.col("pos") / B.TOKEN_DIM).cast("long").alias("tok"), (F.col("pos") % B.TOKEN_DIM).cast("long").alias("dim"), "v")


# head and metrics


@query
def linear_head_logits(spark, sf_dir):
    return B.logits(spark, sf_dir).select("vec_id", r6(F.col("z")[0]).alias("z0"), r6(F.col("z")[1]).alias("z1"))


@query
def mlp_head_logits(spark, sf_dir):
    head = attention.MlpHead.fixed(B.DIMS)
    z = F.col("z")
    return B.embeddings(spark, sf_dir).select(F.col("dataset_idx").alias("vec_id"), head.logits(F.col("embedding")).alias("z")).select("vec_id", r6(z[0]).alias("z0"), r6(z[1]).alias("z1"))


@query
def train_adamw(spark, sf_dir):
    """Losses of a logistic head on the vectors' labels, step by step."""
    rows = B.embeddings(spark, sf_dir).select(F.col("embedding").alias("x"), (F.col("label") % 2).alias("label"))
    losses = training.AdamW(rate=0.05).fit(rows, 3)[1]
    return spark.createDataFrame(list(enumerate(losses)), "step long, loss double").select("step", r6(F.col("loss")).alias("loss"))


@query
def softmax_prob(spark, sf_dir):
    return B.logits(spark, sf_dir).select("vec_id", r6(vectors.softmax(F.col("z"))[1]).alias("p1"))


@query
def argmax_pred(spark, sf_dir):
    return B.logits(spark, sf_dir).select("vec_id", vectors.argmax(F.col("z")).alias("pred"))


def losses(spark, sf_dir) -> DataFrame:
    z = F.col("z")
    return B.logits(spark, sf_dir).select("vec_id", "y", vectors.cross_entropy(z, F.col("y")).alias("ce"), vectors.argmax(z).alias("pred"), vectors.softmax(z)[1].alias("p1"))


@query
def cross_entropy(spark, sf_dir):
    return losses(spark, sf_dir).select("vec_id", r6(F.col("ce")).alias("ce"))


@query
def binary_accuracy(spark, sf_dir):
    return losses(spark, sf_dir).agg(r6(metrics.accuracy("pred", "y")).alias("acc"))


@query
def auroc_exact(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.round("value", 0).alias("score"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return metrics.auroc(rows, "score", "y").select(r6(F.col("auc")).alias("auc"), "one_class")


@query
def epoch_loss(spark, sf_dir):
    per_batch = losses(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / B.BATCH).alias("batch_id")).agg(F.avg("ce").alias("loss"), F.count(F.lit(1)).alias("n"))
    return metrics.epoch_loss(per_batch).select(r6(F.col("loss")).alias("loss"))


@query
def validation_metrics(spark, sf_dir):
    rows = losses(spark, sf_dir)
    auc = metrics.auroc(rows, "p1", "y").select(r6(F.col("auc")).alias("auroc"))
    return rows.agg(r6(F.avg("ce")).alias("loss"), r6(metrics.accuracy("pred", "y")).alias("acc")).crossJoin(F.broadcast(auc))


@query
def best_epoch(spark, sf_dir):
    d = F.col("ts").cast("date")
    e = table(spark, sf_dir, "events").select(d.alias("d"), "value")
    first = F.broadcast(e.agg(F.min("d").alias("first")))
    log = e.crossJoin(first).groupBy(F.datediff("d", "first").cast("long").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("metric"))
    return metrics.best_epoch(log, "metric", 20).select("epoch", r6(F.col("metric")).alias("metric"))


# signals


@query
def patchify_signal(spark, sf_dir):
    s = B.signal(spark, sf_dir)
    n = s.groupBy("ch").agg((F.floor(F.count(F.lit(1)) / PATCH) * PATCH).alias("whole"))
    rows = signals.patchify(s.join(n, "ch").where("t < whole").select("ch", "t", "v"), PATCH)
    return rows.select("ch", "patch", "pos", r6(F.col("v")).alias("v"))


@query
def gaussian_smooth(spark, sf_dir):
    return signals.gaussian_smooth(B.signal(spark, sf_dir).select("ch", "t", F.abs("v").alias("v"))).select("ch", "t", r6(F.col("v")).alias("v"))


@query
def cam_minmax(spark, sf_dir):
    return signals.minmax(B.signal(spark, sf_dir).select("event_id", "v")).select("event_id", r6(F.col("v")).alias("v"))


@query
def signal_zscore(spark, sf_dir):
    return signals.zscore(B.signal(spark, sf_dir).select("ch", "event_id", "v")).select("event_id", r6(F.col("v")).alias("v"))


def rounded_importance(rows: DataFrame) -> DataFrame:
    return signals.channel_importance(rows).select("ch", r6(F.col("t0")).alias("t0"), r6(F.col("t1")).alias("t1"))


@query
def channel_mean_importance(spark, sf_dir):
    return rounded_importance(B.halves(spark, sf_dir))


@query
def channel_rank(spark, sf_dir):
    ranked = signals.channel_ranking(rounded_importance(B.halves(spark, sf_dir)))
    return ranked.select("ch", r6(F.col("total")).alias("total"), "rank")


@query
def channel_importance_ranking(spark, sf_dir):
    ranked = signals.channel_ranking(rounded_importance(B.smoothed_halves(spark, sf_dir)))
    return ranked.select("ch", "t0", "t1", r6(F.col("total")).alias("total"), "rank")


@query
def bar_layout(spark, sf_dir):
    ranked = signals.channel_ranking(rounded_importance(B.halves(spark, sf_dir)))
    return signals.bar_layout(ranked).select("ch", r6(F.col("x0")).alias("x0"), r6(F.col("x1")).alias("x1"), "t0", "t1")


@query
def saliency_flip(spark, sf_dir):
    both = signals.channel_importance(B.halves(spark, sf_dir)).select("ch", F.col("t0").alias("first"), F.col("t1").alias("second"))
    out = signals.flip(both, F.when(F.length("ch") % 2 == 1, 1).otherwise(0))
    return out.select("ch", r6(F.col("cam_0")).alias("cam_0"), r6(F.col("cam_1")).alias("cam_1"))


@query
def trace_layout(spark, sf_dir):
    s = signals.zscore(B.signal(spark, sf_dir).select("ch", "t", "v"))
    pos = s.select("ch").distinct().select("ch", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ch")) - 1).alias("pos"))  # a row for each channel
    out = signals.trace_layout(s.join(pos, "ch"))
    return out.select("ch", "t", r6(F.col("y")).alias("y"), r6(F.col("y_lo")).alias("y_lo"), r6(F.col("y_hi")).alias("y_hi"))


# sources and sinks: what is written to the shared folder is read back


@query
def metadata_file(spark, sf_dir):
    path = work_path(spark, "metadata")
    B.order_names(spark, sf_dir).select("o_orderstatus", F.col("o_orderkey").alias("dataset_idx"), "group_name").write.option("header", True).csv(path)
    return tables.read_metadata(spark, path)


@query
def pair_file(spark, sf_dir):
    path = work_path(spark, "pairs")
    tables.write_pairs(B.order_pairs(spark, sf_dir), path)
    return shown(tables.read_pairs(spark, f"{path}/{tables.PAIR_FILE}"))


@query
def fold_folders(spark, sf_dir):
    path = work_path(spark, "folds")
    tables.write_folds(folded(spark, sf_dir), path)
    return shown(tables.read_folds(spark, path), "fold")


@query
def fold_files(spark, sf_dir):
    path = work_path(spark, "fold-files")
    tables.write_fold_files(folded(spark, sf_dir), path)
    return shown(tables.read_fold_files(spark, path), "fold")


def array_file(spark, sf_dir) -> str:
    path = work_path(spark, "vectors") + ".npy"
    arrays.write_npy(B.embeddings(spark, sf_dir), path)
    return path


@query
def npy_file(spark, sf_dir):
    rows = arrays.read_npy(spark, array_file(spark, sf_dir), rows=300)
    return rows.select("dataset_idx", F.posexplode("embedding").alias("pos", "v")).select("dataset_idx", F.col("pos").cast("long").alias("pos"), r6(F.col("v").cast("double")).alias("v"))


@query
def paired_npy_files(spark, sf_dir):
    path = array_file(spark, sf_dir)
    groups = sampling.group_ids(B.embeddings(spark, sf_dir).select(F.col("dataset_idx").alias("pos")))
    rows = arrays.read_paired_npy(spark, path, path, groups)
    return rows.select("pos", "group", r6(F.aggregate(vectors.delta(F.col("x0"), F.transform("x1", lambda v: 2 * v)), F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query
def importance_file(spark, sf_dir):
    path = work_path(spark, "importance")
    ranked = signals.channel_ranking(rounded_importance(B.halves(spark, sf_dir)))
    tables.write_importance(ranked.withColumn("pos", F.col("rank")), path)
    return spark.read.option("header", True).schema(schema.CHANNEL_IMPORTANCE).csv(path)


def daily_log(spark, sf_dir) -> DataFrame:
    """A log of one row a day of events, in the columns of the metrics log."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("d"), "value")
    log = e.crossJoin(F.broadcast(e.agg(F.min("d").alias("first")))).groupBy(F.datediff("d", "first").alias("epoch"))
    names = [c.split()[0] for c in schema.METRICS.split(", ")][1:]
    return log.agg(*(F.round(F.avg(F.col("value") + k), 4).alias(n) for k, n in enumerate(names)))


@query
def metrics_log(spark, sf_dir):
    path = work_path(spark, "metrics")
    log = daily_log(spark, sf_dir)
    for half in (log.where("epoch < 20"), log.where("epoch >= 20")):
        tables.append_metrics(half, path)
    return tables.read_metrics(spark, path).select(F.col("epoch").cast("long").alias("epoch"), "train_loss", "val_acc", "val_auroc")


@query
def best_checkpoint(spark, sf_dir):
    """The selected epoch's weights, written under its name and read with another bias."""
    best = metrics.best_epoch(daily_log(spark, sf_dir), "val_auroc").first()
    weights = {f"w{c}": row for c, row in enumerate(B.WEIGHTS)} | {"bias": B.BIAS}
    path = checkpoints.write_best(spark, work_path(spark, "checkpoints"), best["epoch"], best["val_auroc"], best["val_acc"], weights)
    got = checkpoints.read_weights(spark, path, {"bias": [0.5, 0.25]})
    rows = [(path.rsplit("/", 1)[1].split("-")[0], name, i, float(v)) for name, values in got.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "epoch string, name string, pos long, v double")


@query
def checkpoint_parameters(spark, sf_dir):
    """Each vector as a checkpoint whose parameters are read as the encoder's are."""
    e = B.embeddings(spark, sf_dir).select(F.col("dataset_idx").alias("vec_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    params = F.create_map(F.lit("student.norm.weight"), F.slice("x", 1, 2), F.lit("head"), F.slice("x", 3, 2))
    holder = F.when(F.col("vec_id") % 2 == 0, "model").otherwise("state_dict")
    full = checkpoints.with_head_norm(checkpoints.student_names(checkpoints.parameters(F.create_map(F.lit("other"), params, holder, params))))
    rows = e.select("vec_id", F.explode(full).alias("name", "v"))
    return rows.select("vec_id", "name", r6(F.col("v")[0]).alias("v0"), r6(F.col("v")[1]).alias("v1"))


@query
def named_channels(spark, sf_dir):
    """Samples by position, given their channels' names by a montage."""
    names = sorted(r["ch"] for r in table(spark, sf_dir, "events").select(F.col("event_type").alias("ch")).distinct().collect())
    montage = arrays.montage(spark, tuple(names))
    rows = B.signal(spark, sf_dir).join(F.broadcast(montage), "ch").select("pos", "t", "event_id")
    return arrays.name_channels(rows, montage).select("event_id", "ch", F.col("pos").cast("long").alias("pos"))


@query
def signal_snippets(spark, sf_dir):
    """Forty samples from the sixth on of each channel's recordings of a day; fewer where one ends."""
    day = B.signal(spark, sf_dir).withColumn("group_name", sampling.day("d"))
    recordings = day.groupBy("group_name", "ch").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("samples"))
    cut = signals.snippet(recordings.withColumnRenamed("ch", "channel"), 5, 40)
    return arrays.long_signal(cut).select("group_name", "ch", "t", r6(F.round("v", 2)).alias("v"))


@query
def saliency_gradient(spark, sf_dir):
    """Gradient of the first class's logit by each number of a vector: mean pool and linear head."""
    rows = vectors.mean_pool_gradient(B.WEIGHTS[0][: B.TOKEN_DIM], B.DIMS // B.TOKEN_DIM)
    return spark.createDataFrame([(t, j, float(v)) for t, row in enumerate(rows) for j, v in enumerate(row)], "tok long, dim long, v double").select("tok", "dim", r6(F.col("v")).alias("v"))
