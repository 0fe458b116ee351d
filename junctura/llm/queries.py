"""The queries of this subpackage: one per operator, with production parameters over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, mix, packing, quality, rules, shard, simhash, store, tokencount, urlfilter
from .common import read_table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3)


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard.assign(read_table(spark, sf_dir, "documents"), shards=8)
    return got.selectExpr("doc_id", "size", "text_crc32", "law", "shard", "slot", "cast(null as int) as grown_shard")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read_table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.write_and_read(spark, read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mix, op2_token_counts, op3_simhash, op4_hilbert_shards, op5_url_filter, op6_packing, op7_quality, op8_nearest, op9_quality_rules, op10_token_store, pipeline)
    return {f.__name__: f for f in found}


_OP5 = """
with u as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
s as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select * from (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) as t(verdict, h, p)),
m as (select s.page_id, s.host, s.path, r.h || r.p as rule, r.verdict, row_number() over (partition by s.page_id, s.host, s.path order by length(r.h || r.p) desc, r.h || r.p) as n
      from s join r on (s.host = r.h or ends_with(s.host, '.' || r.h)) and starts_with(s.path, r.p))
select s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') as verdict
from s left join m on s.page_id is not distinct from m.page_id and s.host = m.host and s.path = m.path and m.n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": _OP5}
