"""The registered queries of this subpackage, by name, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, langid, licenses, lines, mixing, neighbours, quality, records, simhash, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.digest(table(spark, sf_dir, "embeddings"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.digest(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_approximate_neighbours, op3_benchmark_decontamination, op4_simhash_near_dedup, op5_language_id, op6_line_dedup, op7_token_output, op8_license_scan, op9_warc, op10_quality_classifier)}

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: By brute force over all windows.
CONTAMINATION = f"""
with items as (select item_id, {WORDS} as w from benchmark where item_id is not null),
wins as (select item_id, w[s + 1 : s + least(len(w), 10)] as g, least(len(w), 10) as n from (select item_id, w, unnest(range(greatest(len(w) - 9, 1))) as s from items where len(w) > 0)),
sizes as (select distinct n from wins),
docs as (select doc_id, {WORDS} as w from documents),
places as (select doc_id, n, s, w[s + 1 : s + n] as g from (select doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) as s from docs, sizes)),
hits as (select doc_id, p.n, s, item_id from places p join wins using (g)),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(s, s + n)) as k from hits) group by doc_id),
own as (select doc_id, list_sort(list(distinct cast(item_id as varchar))) as ids from hits group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(ids), 0)::bigint as n_items, sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (doc_id) left join own using (doc_id)
"""

#: For page_ids that are unique and not null.
ARCHIVE = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to
from p left join f using (payload_digest)
"""

ORACLE_SQL: dict[str, str] = {"op3_benchmark_decontamination": CONTAMINATION, "op6_line_dedup": lines.SQL, "op8_license_scan": licenses.sql(), "op9_warc": ARCHIVE}
