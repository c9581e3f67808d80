"""Queries p2 to p9 over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import addresses, bpe, capping, copies, langid, lookalike, mixing, mojibake


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records held by two or more lines."""
    lines = table(spark, sf_dir, "lead_lines").select(F.col("line_id").alias("id"), "url", "store_name", "city", "attrs")
    return copies.collapse(lines).where("copies > 1").select(F.col("first_id").alias("first_line_id"), "copies")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every record with its number of copies."""
    lines = table(spark, sf_dir, "lead_lines").select(F.col("line_id").alias("id"), "url", "store_name", "city", "attrs")
    return copies.collapse(lines).select(F.col("first_id").alias("first_line_id"), "copies")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages that lie at the same place."""
    return addresses.same_place(table(spark, sf_dir, "city_pages"), "page_id", ["address", "contact_page_address"])


def p3_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every page that shares one with another page, with the place's first page and its number of pages."""
    return addresses.place_classes(table(spark, sf_dir, "city_pages"), "page_id", ["address", "contact_page_address"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that hold text decoded with a wrong encoding."""
    return p4_restored(spark, sf_dir).select("name_id", "field")


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled values with their restored text and the confused encodings."""
    return mojibake.garbled_fields(table(spark, sf_dir, "site_names"), "name_id", ["original_title", "display_name", "name_warning"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads beyond the 15 best of a contributor in a run."""
    leads = table(spark, sf_dir, "leads")
    who = capping.host_of(F.col("domain"), F.col("url"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("lead_score", F.lit(0))))
    rows = leads.select(F.col("run_id").alias("grp"), who.alias("who"), score.alias("score"), F.col("lead_id").alias("id"))
    return capping.over_cap(rows, max_count=15).select(F.col("id").alias("lead_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of leads whose names and city look the same and aren't the same strings."""
    return lookalike.alike_pairs(table(spark, sf_dir, "leads"), "lead_id", ["display_name", "store_name", "city"])


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of the names and the city of every lead, and their look, in which equal looks are equal strings."""
    columns = ["display_name", "store_name", "city"]
    return lookalike.consistent(table(spark, sf_dir, "leads"), "lead_id", columns).drop("raw")


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every lead that looks like another one, with the number of its links."""
    return lookalike.alike_classes(table(spark, sf_dir, "leads"), "lead_id", ["display_name", "store_name", "city"]).drop("raw")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode_table(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the sources by their target shares."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source of the target table."""
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a missing or wrong language label or paragraphs of several languages, a row for each language."""
    documents = table(spark, sf_dir, "documents")
    return langid.found(documents, langid.fit(documents))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document (segment 0) and every paragraph."""
    documents = table(spark, sf_dir, "documents")
    return langid.segments(documents, langid.fit(documents))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [p2_found, p2_records, p3_found, p3_places, p4_found, p4_restored, p5_found, p6_found, p6_forms, p6_classes, p7_ids, p8_mix, p8_shares, p9_found, p9_segments]
    return {f.__name__: f for f in made}


P5 = r"""
WITH h AS (
  SELECT run_id, lead_id, greatest(0, least(100, coalesce(lead_score, 0))) AS s,
    lower(trim(CASE WHEN trim(coalesce(domain, ''), E' \t\r\n　') = '' THEN url ELSE domain END, E' \t\r\n　')) AS x FROM leads
), k AS (
  SELECT run_id, lead_id, s,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), ':[0-9]*$', ''), '\.$', ''), '^www\.', '') AS who FROM h
), r AS (
  SELECT lead_id, row_number() OVER (PARTITION BY run_id, who ORDER BY s DESC, lead_id) AS n FROM k WHERE who IS NOT NULL AND who <> ''
)
SELECT lead_id FROM r WHERE n > 15
"""
P2 = r"""
WITH t AS (
  SELECT line_id, url, attrs,
    regexp_replace(lower(store_name), '[\s\p{Z}\p{P}\p{Cc}\p{Cf}]+', '', 'g') AS store, regexp_replace(lower(city), '[\s\p{Z}\p{P}\p{Cc}\p{Cf}]+', '', 'g') AS town,
    regexp_replace(lower(url), '[\s\p{Z}]+', '', 'g') AS u FROM lead_lines
), k AS (
  SELECT line_id, store, town, split_part(u, '://', 1) AS scheme,
    regexp_replace(regexp_replace(split_part(u, '://', 2), '[?#].*$', ''), '[\p{P}]+', '', 'g') AS base,
    list_sort(list_filter(list_transform(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'), lambda q: regexp_replace(q, '[\p{P}]+', '', 'g')), lambda q: q <> '')) AS query,
    list_sort(list_filter(list_transform(regexp_split_to_array(lower(attrs), '[;,、/]'), lambda e: regexp_replace(regexp_replace(e, '[:：]', '='), '[\s\p{Z}\p{P}]+', '', 'g')), lambda e: e <> '')) AS entries
  FROM t
)
SELECT min(line_id) AS first_line_id, count(*) AS copies FROM k GROUP BY scheme, base, query, store, town, entries
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2.rstrip() + " HAVING count(*) > 1", "p2_records": P2, "p5_found": P5}
