"""Queries of this package: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.llm import (
    alignment, exact_dedup, extraction, fingerprint, language_id, mixing, near_dedup, packing, substring, toxicity,
    url_filter, warc, whitening,
)
from flowlens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; NULL for a NULL id, which is thus in no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(documents(spark, sf_dir), id_remainder("doc_id", 4) != 2)
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    return found.withColumn("held_out", held_out)


@query("op2_warc", """
    with p as (
        select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes,
               sha256(coalesce(html, '')) as payload_digest
        from pages
    ), r as (
        select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first_id from p
    )
    select page_id, payload_bytes, payload_digest,
           case when page_id is distinct from first_id and first_id is not null then 'revisit' else 'response' end as record_type,
           case when page_id is distinct from first_id then first_id end as refers_to
    from r
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return warc.read_archives(spark, root).drop("url", "file")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, "doc_id", "text", labels, "toxic", id_remainder("id", 5) != 0)
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return toxicity.score(docs, model).withColumn("held_out", held_out)


@query("op4_exact_dedup", """
    with n as (
        select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm
        from documents
    ), g as (
        select doc_id, norm, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size
        from n
    )
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


@query("op5_mixing", f"""
    with sizes as (
        select source, sum(coalesce(length(text), 0))::double as chars from documents group by source
    ), rated as (
        select source, case when chars > 0 then pow(chars, {mixing.EVENNESS}) / (select sum(pow(chars, {mixing.EVENNESS})) from sizes)
            * (select sum(chars) from sizes) / chars else 1.0 end as rate from sizes
    ), steps as (
        select source, rate, greatest(ceil(rate / {mixing.MEAN_STEP}), 1)::int as parts, k,
               exp(-rate / greatest(ceil(rate / {mixing.MEAN_STEP}), 1) + k * ln(rate / greatest(ceil(rate / {mixing.MEAN_STEP}), 1))
                   - lgamma(k + 1)) as p
        from rated, range(0, {mixing.TABLE + 1}) t(k)
    ), cdfs as (
        select source, rate, parts, k, sum(p) over (partition by source order by k) as cdf from steps
    ), draws as (
        select doc_id, source, text, j,
               ('0x' || substr(md5('{mixing.SEED}:' || doc_id || ':' || j), 1, 13))::bigint / pow(16.0, 13) as u
        from documents join (select distinct source, parts from cdfs) using (source), lateral range(1, parts + 1) r(j)
    ), counts as (
        select d.doc_id, d.source, any_value(d.text) as text, any_value(c.rate) as rate, count(*) filter (c.cdf <= d.u) as copies
        from draws d join cdfs c using (source) group by d.doc_id, d.source
    )
    select doc_id, source, text, round(rate, 9) as rate, copies::int as copies, copy::int as copy,
           md5('{mixing.SEED}:' || doc_id || ':copy:' || copy) as key
    from counts, lateral range(1, copies + 1) r(copy)
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


@query("op6_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(documents(spark, sf_dir))


@query("op8_fingerprint")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query("op10_url_filter")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op11_extraction")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op13_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir)).documents
