"""The operators' registered queries, with the SQL that DuckDB can run beside them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagpair.llm import decontaminate, language_id, near_dedup, packing, quality_rules, secrets, token_counts, token_store, toxicity, warc
from lagpair.llm.common import documents


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), shingle=4, percent=80)


OP1_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[k : k + 3], ' ') as s from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) as k from w where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
i as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), l as (
  select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), e as (select a, b from l union all select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from documents union select e.b, r.c from r join e on e.a = r.doc_id)
select doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(c) as component_id, doc_id = min(c) as kept from r left join n using (doc_id) group by doc_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.rollup(documents(spark, sf_dir), token_counts.RollupStore(spark))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h, max(page_id) over (partition by sha1(coalesce(html, ''))) as top_id
  from pages
), c as (
  select *, [('0x' || substr(h, 1 + 10 * k, 10))::bigint for k in range(4)] as v from p
)
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v[1 + (i // 8)::bigint] >> (35 - 5 * (i % 8))) & 31) + 1)::bigint, 1) for i in range(32)], '') as payload_digest,
  case when page_id = top_id then 'response' else 'revisit' end as record_type,
  case when page_id = top_id then null else top_id end as refers_to
from c
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP8_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null
), win as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as k from iw where len(w) > 0)
), sizes as (select distinct n from win),
dwin as (
  select doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from dw, sizes where len(w) >= n)
), hits as (
  select d.doc_id, d.k, d.n, win.item_id from dwin d join win on d.n = win.n and d.s = win.s
), words as (
  select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + n)) as pos from (select distinct doc_id, k, n from hits)) group by doc_id
), items as (
  select doc_id, count(*) as n_items, sha256(string_agg(i, ',' order by i)) as items_sha256 from (select distinct doc_id, item_id::varchar as i from hits) group by doc_id
)
select dw.doc_id, len(dw.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (doc_id) left join items using (doc_id)
"""

def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.new_folder(spark)
    manifest = token_store.write_tokens(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_documents(manifest, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_decontaminate": op8_decontaminate,
    "op9_packing": op9_packing,
    "op10_token_store": op10_token_store,
}
ORACLES: dict[str, str] = {"op1_near_dedup": OP1_SQL, "op4_warc": OP4_SQL, "op8_decontaminate": OP8_SQL}
