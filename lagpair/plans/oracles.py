"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

import numpy as np

from lagpair.operators.attention import AttentivePool, MlpHead
from lagpair.operators.signals import gaussian_kernel
from lagpair.plans.bindings import BATCH, BIAS, DIMS, DRAWS, FOLDS, SEED, TEST_FOLD, TOKEN_DIM, WEIGHTS
from lagpair.plans.queries import PATCH

O = "o as (select o_custkey::varchar as id, o_orderdate::date as d, o_orderkey, o_orderstatus, o_custkey || '_' || strftime(o_orderdate, '%Y_%m_%d') || '_' || o_orderkey as group_name from orders)"
OP = f"{O}, op as (select * from (select id, d as before, lead(d) over (partition by id order by d, group_name) as after from (select distinct id, d, group_name from o)) where after is not null)"
E = "e as (select user_id::varchar as id, ts::date as d, event_id % (select count(*) from embeddings) as idx, event_id as tie from events)"
EP = f"{E}, ep as (select * from (select id, d as before, lead(d) over (partition by id order by d) as after from (select distinct id, d from e)) where after is not null)"
DATES = "strftime(before, '%Y-%m-%d') as before_date, strftime(after, '%Y-%m-%d') as after_date"
RANKED = f"{EP}, ids as (select id, row_number() over (order by md5('{SEED}|' || id), id) as r, count(*) over () as n from (select distinct id from ep))"
FM = f"{RANKED}, fm as (select id, ntile({FOLDS}) over (order by r) as fold from ids), fp as (select ep.*, fm.fold from ep join fm using (id))"


def hashed(side: str, *more: str) -> str:
    parts = ", ".join(f"'{x}'" for x in (SEED, side, *more))
    return f"('0x' || substr(md5(concat_ws('|', {parts}, id, strftime(before, '%Y-%m-%d'), strftime(after, '%Y-%m-%d'), draw::varchar)), 1, 7))::bigint"


DRAWN = f"{EP}, dr as (select ep.*, unnest(range({DRAWS})) as draw from ep)"
EX = f"""{DRAWN}, li as (select id, d, list(idx order by idx, tie) as idxs from e group by id, d),
ex as (select dr.id, before, after, draw, a.idxs[{hashed('i0')} % len(a.idxs) + 1] as i0, b.idxs[{hashed('i1')} % len(b.idxs) + 1] as i1, {hashed('label')} % 2 as label
  from (select id, before, after, draw from dr) dr join (select id as aid, d as ad, idxs from li) a on a.aid = dr.id and a.ad = before join (select id as bid, d as bd, idxs from li) b on b.bid = dr.id and b.bd = after)"""
VP = f"{EX}, vp as (select ex.*, x.embedding as x0, y.embedding as x1 from ex join embeddings x on x.vec_id = i0 join embeddings y on y.vec_id = i1)"
TOK = f"tok as (select vec_id, i % {TOKEN_DIM} as dim, i // {TOKEN_DIM} as tok, i as pos, embedding[i + 1]::double as v from (select vec_id, embedding, unnest(range(len(embedding))) as i from embeddings))"


def logit(c: int) -> str:
    row = "[" + ", ".join(repr(float(w)) for w in WEIGHTS[c]) + "]"
    return f"list_sum([embedding[j]::double * ({row})[j] for j in range(1, len(embedding) + 1)]) + ({BIAS[c]})"


Z = f"z as (select vec_id, label % 2 as y, {logit(0)} as z0, {logit(1)} as z1 from embeddings)"
L = f"{Z}, l as (select vec_id, y, (z1 > z0)::bigint as pred, exp(z1 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) as p1, ln(exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) + greatest(z0, z1) - case when y = 0 then z0 else z1 end as ce from z)"
S = "s as (select event_type as ch, row_number() over (partition by event_type order by ts, event_id) - 1 as t, value as v, event_id, ts::date as d from events)"
H = f"{S}, h as (select ch, t, v, case when 2 * t < count(*) over (partition by ch) then 0 else 1 end as timepoint from s)"


def literal(x: np.ndarray) -> str:
    return "[" + ", ".join(literal(v) if np.ndim(v) else repr(float(v)) for v in x) + "]"


def dense(x: str, weight: np.ndarray, bias: np.ndarray) -> str:
    """weight times the list x, and bias."""
    return f"[list_dot_product({x}, ({literal(weight)})[i]) + ({literal(bias)})[i] for i in range(1, {len(bias)} + 1)]"


def gelu(x: str) -> str:
    """GELU of each number of a list, with the series of the error function."""
    series = "list_sum([(case when n % 2 = 0 then 1 else -1 end) * pow(y / sqrt(2.0), 2 * n + 1) / (gamma(n + 1.0) * (2 * n + 1)) for n in range(80)])"
    return f"[y * 0.5 * (1 + 2 / sqrt(pi()) * {series}) for y in {x}]"


def attentive() -> str:
    """Attentive pooling of every vector with the fixed weights, head by head."""
    model = AttentivePool.fixed(TOKEN_DIM, TOKEN_DIM, heads=2)
    w, width = model.weights, TOKEN_DIM // 2
    return f"""tk as (select vec_id, [embedding[t * {TOKEN_DIM} + j]::double for j in range(1, {TOKEN_DIM} + 1)] as x from (select vec_id, embedding, unnest(range(len(embedding) // {TOKEN_DIM})) as t from embeddings)),
kv as (select vec_id, {dense(literal(w['query'][0]), w['wq'], w['bq'])} as q, {dense('x', w['wk'], w['bk'])} as k, {dense('x', w['wv'], w['bv'])} as v from tk),
sc as (select vec_id, h, v[h * {width} + 1 : h * {width} + {width}] as v, list_dot_product(q[h * {width} + 1 : h * {width} + {width}], k[h * {width} + 1 : h * {width} + {width}]) / sqrt({width}.0) as z from (select *, unnest(range(2)) as h from kv)),
ex_ as (select vec_id, h, v, exp(z - max(z) over (partition by vec_id, h)) as e from sc),
hd as (select vec_id, h, i, sum(e * v[i]) / sum(e) as o from (select *, unnest(range(1, {width} + 1)) as i from ex_) group by vec_id, h, i),
al as (select vec_id, list(o order by h, i) as o from hd group by vec_id),
po as (select vec_id, {dense('o', w['wo'], w['bo'])} as o from al),
up_ as (select vec_id, {dense('o', w['up'], w['up_b'])} as u from po),
ge as (select vec_id, {gelu('u')} as u from up_),
pooled as (select vec_id, {dense('u', w['down'], w['down_b'])} as p from ge)"""


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)::double"


def auc(source: str, score: str) -> str:
    return f"(select sum(p * (below + n / 2)) / (sum(p) * sum(n)) from (select p, n, coalesce(sum(n) over (order by sc rows between unbounded preceding and 1 preceding), 0) as below from (select {score} as sc, count(*) filter (y = 1) as p, count(*) filter (y = 0) as n from {source} where {score} is not null group by 1)))"


def smooth(source: str, keys: str) -> str:
    """Relational smoothing of (keys, t, v): the values of a signal as a list, mirrored by index, times the kernel."""
    kernel = gaussian_kernel()
    radius = len(kernel) // 2
    weights = "[" + ", ".join(repr(w) for w in kernel) + "]"
    mirrored = f"(({{p}} % (2 * n) + 2 * n) % (2 * n))"
    place = mirrored.format(p=f"(t + k - {radius})")
    at = f"case when {place} < n then {place} else 2 * n - 1 - {place} end"
    return f"""k as (select unnest(range({len(kernel)})) as k, unnest({weights}) as w),
sig as (select {keys}, t, v, count(*) over (partition by {keys}) as n from {source}),
want as (select {keys}, t, w, {at} as src from sig cross join k),
sm as (select {', '.join('want.' + c.strip() for c in keys.split(','))}, want.t, sum(w * sig.v) as v from want join sig on {' and '.join(f'want.{c.strip()} = sig.{c.strip()}' for c in keys.split(','))} and sig.t = want.src group by all)"""


def pooled(how: str) -> str:
    return f"with {TOK} select vec_id, dim::bigint as dim, {r6(how + '(v)')} as v from tok group by vec_id, dim"


def delta(value: str, dims: int, more: str = "") -> str:
    return f"with {VP} select id, {DATES}, draw, i::bigint as dim, {r6(value)} as v{more} from (select *, unnest(range({dims})) as i from vp)"


MEANS = f"(list_sum([x1[i + 1 + {TOKEN_DIM} * k]::double for k in range(len(x1) // {TOKEN_DIM})]) - list_sum([x0[i + 1 + {TOKEN_DIM} * k]::double for k in range(len(x0) // {TOKEN_DIM})])) / (len(x0) // {TOKEN_DIM})"
IMPORTANCE = f"{H}, imp as (select ch, {r6('avg(v) filter (timepoint = 0)')} as t0, {r6('avg(v) filter (timepoint = 1)')} as t1 from h group by ch)"
SMOOTHED = f"""{H}, own as (select ch, timepoint, t - min(t) over (partition by ch, timepoint) as t, abs(v) as v from h),
{smooth('own', 'ch, timepoint')},
imp as (select ch, {r6('avg(v) filter (timepoint = 0)')} as t0, {r6('avg(v) filter (timepoint = 1)')} as t1 from sm group by ch)"""
RANK = "row_number() over (order by t0 + t1 desc, ch) as rank"

MLP = MlpHead.fixed(DIMS)
LOG = ("train_loss", "train_acc", "train_auroc", "val_loss", "val_acc", "val_auroc")
DAILY = f"with log as (select date_diff('day', (select min(ts::date) from events), ts::date) as epoch, {', '.join(f'round(avg(value + {k}), 4) as {n}' for k, n in enumerate(LOG))} from events group by 1)"

ORACLES: dict[str, str] = {
    "parse_group_name": f"with {O} select group_name, regexp_extract(group_name, '^(\\d+)_(\\d{{4}})_(\\d{{2}})_(\\d{{2}})', 1) as id, regexp_extract(group_name, '^(\\d+)_(\\d{{4}})_(\\d{{2}})_(\\d{{2}})', 2) as y, regexp_extract(group_name, '^(\\d+)_(\\d{{4}})_(\\d{{2}})_(\\d{{2}})', 3) as m, regexp_extract(group_name, '^(\\d+)_(\\d{{4}})_(\\d{{2}})_(\\d{{2}})', 4) as d from o",
    "split_group_name": f"with {O} select group_name, split_part(group_name, '_', 1)::int as id, split_part(group_name, '_', 2)::int as y, split_part(group_name, '_', 3)::int as m, split_part(group_name, '_', 4)::int as d from o",
    "session_date": f"with {O} select group_name, strftime(d, '%Y-%m-%d') as session_date from o",
    "zero_pad_dates": f"with {O} select group_name, strftime(d, '%m') as m_pad, strftime(d, '%d') as d_pad from o",
    "distinct_sessions": f"with {O} select distinct group_name from o",
    "longitudinal_pairs": f"with {OP} select id as ID, strftime(before, '%Y') as Year_Before, strftime(before, '%m') as Month_Before, strftime(before, '%d') as Day_Before, strftime(after, '%Y') as Year_After, strftime(after, '%m') as Month_After, strftime(after, '%d') as Day_After from op",
    "date_index_collect": f"with {E} select id, strftime(d, '%Y-%m-%d') as date, count(*) as n, min(idx) as first_idx, max(idx) as last_idx, string_agg(idx::varchar, ',' order by idx) as idxs from e group by id, d",
    "valid_pairs_semi_join": f"with {OP}, i as (select distinct id, d from o where o_orderstatus = 'F') select id, {DATES} from op where (id, before) in (select (id, d) from i) and (id, after) in (select (id, d) from i)",
    "invalid_pairs_anti_join": f"with {OP}, i as (select distinct id, d from o where o_orderstatus = 'F') select id, {DATES} from op where not ((id, before) in (select (id, d) from i) and (id, after) in (select (id, d) from i))",
    "fold_ntile": f"with {FM} select id, fold from fm",
    "fold_assignment": f"with {FM} select id, {DATES}, fold from fp",
    "fold_train_test": f"with {FM} select id, {DATES}, case when fold = {TEST_FOLD} then 'test' else 'train' end as split from fp",
    "union_train_folds": f"with {FM} select id, {DATES} from fp where fold <> {TEST_FOLD}",
    "kfold_sizes": f"with {FM} select t.test_fold, count(*) filter (fold <> t.test_fold) as n_train, count(*) filter (fold = t.test_fold) as n_test from fp, (select unnest(range(1, {FOLDS} + 1)) as test_fold) t group by 1",
    "group_shuffle_split": f"with {RANKED} select id, case when r <= floor(n * 0.6) then 'train' else 'test' end as split from ids",
    "epoch_length": f"with {EP} select count(*) as n_pairs, count(*) * {DRAWS} as n_examples from ep",
    "expand_draws": f"with {DRAWN} select id, {DATES}, draw from dr",
    "draw_index_to_pair": f"with {EP} select g as global_idx, g // {DRAWS} as pair_idx from (select unnest(range((select count(*) from ep) * {DRAWS})) as g)",
    "sample_instances": f"with {EX} select id, {DATES}, draw, i0, i1, label from ex",
    "random_label": f"with {DRAWN} select id, {DATES}, draw, {hashed('label')} % 2 as label from dr",
    "order_label_swap": f"with {EX} select id, {DATES}, draw, case when label = 1 then i1 else i0 end as idx_1, case when label = 1 then i0 else i1 end as idx_2, label from ex",
    "eval_batches": f"with {EX} select b as batch_id, count(*) as n from (select (row_number() over (order by id, before, after, draw) - 1) // {BATCH} as b from ex) group by 1",
    "pair_embedding_lookup": f"with {VP} select id, {DATES}, draw, {r6('list_sum([v::double for v in x0])')} as sum_0, {r6('list_sum([v::double for v in x1])')} as sum_1, {r6('list_sum([x0[j]::double * x1[j]::double for j in range(1, len(x0) + 1)])')} as dot from vp",
    "all_pairs_join": f"with {EP} select ep.id, a.idx as idx_before, b.idx as idx_after from ep join e a on a.id = ep.id and a.d = ep.before join e b on b.id = ep.id and b.d = ep.after",
    "pool_mean": pooled("avg"),
    "pool_max": pooled("max"),
    "pool_concat": f"with {TOK} select vec_id, pos::bigint as pos, {r6('v')} as v from tok",
    "delta_raw": delta("x1[i + 1]::double - x0[i + 1]::double", 64),
    "delta_mean": delta(MEANS, TOKEN_DIM),
    "extract_delta_embeddings": delta(f"case when label = 1 then -({MEANS}) else {MEANS} end", TOKEN_DIM, ", label"),
    "repeat_group_ids": "select vec_id // 4 as \"group\", 16::bigint as n from embeddings where vec_id % 4 = 0",
    "subset_by_index": f"with {EX} select vec_id from embeddings where vec_id in (select i0 from ex)",
    "linear_head_logits": f"with {Z} select vec_id, {r6('z0')} as z0, {r6('z1')} as z1 from z",
    "softmax_prob": f"with {L} select vec_id, {r6('p1')} as p1 from l",
    "argmax_pred": f"with {L} select vec_id, pred from l",
    "cross_entropy": f"with {L} select vec_id, {r6('ce')} as ce from l",
    "binary_accuracy": f"with {L} select {r6('avg((pred = y)::int)')} as acc from l",
    "auroc_exact": f"with ev as (select round(value, 0) as score, (event_type = 'purchase')::int as y from events) select {r6(auc('ev', 'score'))} as auc, (select count(distinct y) < 2 from ev where score is not null) as one_class",
    "epoch_loss": f"with {L} select {r6('sum(loss * n) / sum(n)')} as loss from (select avg(ce) as loss, count(*) as n from l group by vec_id // {BATCH})",
    "validation_metrics": f"with {L} select {r6('avg(ce)')} as loss, {r6('avg((pred = y)::int)')} as acc, {r6(auc('l', 'p1'))} as auroc from l",
    "best_epoch": f"with g as (select date_diff('day', (select min(ts::date) from events), ts::date) as epoch, round(avg(value), 6) as metric from events group by 1) select epoch, {r6('metric')} as metric from g where epoch >= 20 and metric is not null order by metric desc, epoch limit 1",
    "patchify_signal": f"with {S} select ch, t // {PATCH} as patch, t % {PATCH} as pos, {r6('v')} as v from (select *, count(*) over (partition by ch) // {PATCH} * {PATCH} as whole from s) where t < whole",
    "gaussian_smooth": f"with {S}, a as (select ch, t, abs(v) as v from s), {smooth('a', 'ch')} select ch, t, {r6('v')} as v from sm",
    "cam_minmax": f"with {S} select event_id, {r6('(v - (select min(v) from s)) / ((select max(v) from s) - (select min(v) from s) + 1e-8)')} as v from s",
    "signal_zscore": f"with {S} select event_id, {r6('(v - avg(v) over (partition by ch)) / (stddev_pop(v) over (partition by ch) + 1e-8)')} as v from s",
    "channel_mean_importance": f"with {IMPORTANCE} select ch, t0, t1 from imp",
    "channel_rank": f"with {IMPORTANCE} select ch, {r6('t0 + t1')} as total, {RANK} from imp",
    "channel_importance_ranking": f"with {SMOOTHED} select ch, t0, t1, {r6('t0 + t1')} as total, {RANK} from imp",
    "bar_layout": f"with {IMPORTANCE}, r as (select *, {RANK} from imp) select ch, {r6('rank - 1 - 0.175')} as x0, {r6('rank - 1 + 0.175')} as x1, t0, t1 from r",
    "saliency_flip": f"with {IMPORTANCE} select ch, case when length(ch) % 2 = 1 then t1 else t0 end as cam_0, case when length(ch) % 2 = 1 then t0 else t1 end as cam_1 from imp",
    "trace_layout": f"with {S}, p as (select ch, row_number() over (order by ch) - 1 as pos from (select distinct ch from s)), q as (select ch, t, (v - avg(v) over (partition by ch)) / (stddev_pop(v) over (partition by ch) + 1e-8) as v from s) select ch, t, {r6('v + 6.0 * pos')} as y, {r6('6.0 * pos - 2.5')} as y_lo, {r6('6.0 * pos + 2.5')} as y_hi from q join p using (ch)",
    "rejected_names": f"with {O} select distinct 'x' || group_name as group_name from o where o_orderstatus = 'O'",
    "exact_folds": f"with {EP}, n as (select count(distinct id) as n from ep) select f as fold, n // {FOLDS} + (f <= n % {FOLDS})::int as n, n // {FOLDS} + (f <= n % {FOLDS})::int as n_ids from n, (select unnest(range(1, {FOLDS} + 1)) as f)",
    "epoch_order": f"with {DRAWN} select id, {DATES}, draw, row_number() over (order by ('0x' || substr(md5(concat_ws('|', '{SEED}', '3', id, before::varchar, after::varchar, draw::varchar)), 1, 7))::bigint, id, before, after, draw) - 1 as place from dr",
    "train_test_batches": f"""with {EX}, ids as (select id, row_number() over (order by md5('{SEED}|' || id), id) as r from (select distinct id from ep)), fm as (select id, ntile({FOLDS}) over (order by r) as fold from ids),
te as (select ex.*, 'test' as split, (row_number() over (order by id, before, after, draw) - 1) // {BATCH} as batch_id from ex join fm using (id) where fold = {TEST_FOLD}),
tr as (select dr.id, before, after, draw, a.idxs[{hashed('i0', '0')} % len(a.idxs) + 1] as i0, b.idxs[{hashed('i1', '0')} % len(b.idxs) + 1] as i1, {hashed('label', '0')} % 2 as label, 'train' as split,
  (row_number() over (order by ('0x' || substr(md5(concat_ws('|', '{SEED}', '0', dr.id, before::varchar, after::varchar, draw::varchar)), 1, 7))::bigint, dr.id, before, after, draw) - 1) // {BATCH} as batch_id
  from (select dr.* from dr join fm using (id) where fold <> {TEST_FOLD}) dr join (select id as aid, d as ad, idxs from li) a on a.aid = dr.id and a.ad = before join (select id as bid, d as bd, idxs from li) b on b.bid = dr.id and b.bd = after)
select id, {DATES}, draw, i0, i1, label, split, batch_id from (select id, before, after, draw, i0, i1, label, split, batch_id from te union all select id, before, after, draw, i0, i1, label, split, batch_id from tr)""",
    "pool_attentive": f"with {attentive()} select vec_id, (i - 1)::bigint as dim, {r6('p[i]')} as v from (select *, unnest(range(1, {TOKEN_DIM} + 1)) as i from pooled)",
    "delta_attentive": f"with {EX}, {attentive()} select id, {DATES}, draw, (i - 1)::bigint as dim, {r6('y.p[i] - x.p[i]')} as v from (select *, unnest(range(1, {TOKEN_DIM} + 1)) as i from ex) ex join pooled x on x.vec_id = i0 join pooled y on y.vec_id = i1",
    "mlp_head_logits": f"""with hi as (select vec_id, {dense('[v::double for v in embedding]', MLP.hidden, MLP.hidden_b)} as u from embeddings), ge as (select vec_id, {gelu('u')} as u from hi),
z as (select vec_id, {dense('u', MLP.out, MLP.out_b)} as z from ge) select vec_id, {r6('z[1]')} as z0, {r6('z[2]')} as z1 from z""",
    "metadata_file": f"with {O} select group_name, o_orderkey as dataset_idx from o",
    "pair_file": f"with {OP} select id, {DATES} from op",
    "fold_folders": f"with {FM} select id, {DATES}, fold from fp",
    "fold_files": f"with {FM} select id, {DATES}, fold from fp",
    "npy_file": f"select vec_id as dataset_idx, i::bigint as pos, {r6('embedding[i + 1]::double')} as v from (select *, unnest(range(len(embedding))) as i from embeddings)",
    "paired_npy_files": f"select vec_id as pos, vec_id // 4 as \"group\", {r6('list_sum([v::double for v in embedding])')} as total from embeddings",
    "importance_file": f"with {IMPORTANCE} select ch as \"Channel\", t0 as \"Mean_Importance_T0\", t1 as \"Mean_Importance_T1\" from imp",
    "metrics_log": f"{DAILY} select epoch::bigint as epoch, train_loss, val_acc, val_auroc from log",
    "best_checkpoint": f"{DAILY}, b as (select epoch from log where epoch >= 20 order by val_auroc desc, epoch limit 1), w as (select unnest([{', '.join(f"{{'name': 'w{c}', 'v': {literal(np.array(row))}}}" for c, row in enumerate(WEIGHTS))}, {{'name': 'bias', 'v': [0.5, 0.25]}}]) as w) select 'epoch=' || lpad(epoch::varchar, greatest(2, len(epoch::varchar))::int, '0') as epoch, w.name as name, i::bigint as pos, w.v[i + 1]::double as v from (select epoch, w, unnest(range(len(w.v))) as i from b, w)",
    "checkpoint_parameters": f"select vec_id, name, {r6('embedding[k]::double')} as v0, {r6('embedding[k + 1]::double')} as v1 from embeddings, (select unnest(['norm.weight', 'fc_norm.weight', 'head']) as name, unnest([1, 1, 3]) as k)",
    "named_channels": "select event_id, event_type as ch, dense_rank() over (order by event_type) - 1 as pos from events",
    "signal_snippets": f"with {S} select group_name, ch, t - 5 as t, {r6('round(v, 2)')} as v from (select strftime(d, '%Y-%m-%d') as group_name, ch, row_number() over (partition by ch, d order by t) - 1 as t, v from s) where t >= 5 and t < 45",
    "saliency_gradient": f"select t as tok, j as dim, {r6(f'({literal(np.array(WEIGHTS[0][:TOKEN_DIM]))})[j + 1] / {DIMS // TOKEN_DIM}')} as v from (select unnest(range({DIMS // TOKEN_DIM})) as t), (select unnest(range({TOKEN_DIM})) as j)",
}
