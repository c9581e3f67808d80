"""Queries of composite plans and of event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..session import table
from . import pipeline
from .registry import query

RULES = pipeline.LeadRules(blocked=["kuchikomi-navi.example"], keywords=[rules.Rule("写真館", "photo")], boosts=[rules.Rule("salon", "", 5), rules.Rule("ピアノ", "", 8)], boost_cap=10)
TRIM = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
ONE = r"regexp_replace(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'), '^ +| +$', '', 'g')"
PICK = "coalesce(" + ", ".join("nullif(" + TRIM.format(x=c) + ", '')" for c in ("store_name", "display_name")) + ", '')"


@query(rf"""
WITH n AS (SELECT lead_id AS seq, coalesce({TRIM.format(x="url")}, '') AS url, {ONE.format(x=PICK)} AS nm, coalesce({ONE.format(x="city")}, '') AS city, greatest(0, least(100, coalesce(lead_score, 0))) AS s, coalesce(sales_label, '') AS label FROM leads),
a AS (SELECT *, nm AS name, regexp_replace(lower(regexp_extract(CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END, '://([^/?#]*)', 1)), '^www\.', '') AS domain,
  regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM n),
b AS (SELECT *, CASE WHEN url = '' THEN '' ELSE 'https://' || domain || CASE WHEN p = '' THEN '/' ELSE p END END AS url_strict, translate(regexp_replace(lower(name), '[・\-_\s\p{{Z}}.,!?''"()\[\]{{}}/\\【】「」『』（）]', '', 'g'), '０１２３４５６７８９', '0123456789') AS name_key,
  greatest(0, least(100, s + least(10, CASE WHEN contains(lower(url || ' ' || name), 'salon') THEN 5 ELSE 0 END + CASE WHEN contains(lower(url || ' ' || name), 'ピアノ') THEN 8 ELSE 0 END))) AS score FROM a),
k AS (SELECT *, CASE WHEN name <> '' THEN name_key || '|' || translate(regexp_replace(lower(city), '[・\-_\s\p{{Z}}.,!?''"()\[\]{{}}/\\【】「」『』（）]', '', 'g'), '０１２３４５６７８９', '0123456789') ELSE '' END AS k2 FROM b WHERE NOT (domain = 'kuchikomi-navi.example' OR ends_with(domain, '.kuchikomi-navi.example')) AND NOT contains(lower(url || ' ' || name), '写真館')),
r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN url_strict <> '' THEN 'u' || url_strict ELSE 'n' || k2 END ORDER BY score DESC, seq) AS n FROM k WHERE url_strict <> '' OR k2 <> '')
SELECT seq, url, name, city, CAST(score AS INTEGER) AS score, label, url_strict, domain, name_key, '' AS filter_reason, CASE WHEN score >= 60 THEN 'A' WHEN score >= 40 THEN 'B' ELSE 'C' END AS grade, CAST(CASE label WHEN '○' THEN 2 WHEN '△' THEN 1 ELSE 0 END AS INTEGER) AS label_order FROM r WHERE n = 1
""")
def lead_list(spark: SparkSession, d: str) -> DataFrame:
    leads = table(spark, d, "leads").withColumn("seq", F.col("lead_id"))
    return pipeline.lead_list(leads, RULES)


@query(r"""
WITH h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS dom, lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)) AS p FROM city_pages WHERE regexp_matches(url, '^https?://[^/?#]+')),
f AS (SELECT *, CASE WHEN len(url) - len(replace(url, '/', '')) > 3 THEN regexp_replace(url, '/+$', '') ELSE url END AS web FROM h WHERE NOT (dom = 'salon-mado.example' OR ends_with(dom, '.salon-mado.example'))),
o AS (SELECT *, row_number() OVER (PARTITION BY web ORDER BY page_id) AS n FROM f),
r AS (SELECT page_id, row_number() OVER (PARTITION BY dom ORDER BY CASE WHEN p IN ('', '/') THEN 0 ELSE 1 END, page_id) AS domain_rank FROM o WHERE n = 1)
SELECT page_id, CAST(domain_rank AS INTEGER) AS domain_rank FROM r WHERE domain_rank <= 5
""")
def prefiltered_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "city_pages").select("page_id", "url")
    out = pipeline.prefilter(hits, pipeline.LeadRules(blocked=["salon-mado.example"]), per_domain=5, seq="page_id")
    return out.select("page_id", F.col("domain_rank").cast("int").alias("domain_rank"))


@query("""
WITH c AS (SELECT c_custkey AS lead_id, 'd' || c_nationkey AS domain FROM customer), f AS (SELECT user_id AS lead_id, 'd' || (user_id % 7) AS domain, event_type AS status, ts, event_id FROM events WHERE event_type IN ('purchase', 'error')),
i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY ts DESC, event_id DESC) AS n FROM f) WHERE n = 1), g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) AS n FROM f) WHERE n = 1)
SELECT c.lead_id, coalesce(i.status, g.status) AS status, coalesce(CAST(coalesce(i.ts, g.ts) AS DATE) = DATE '2024-01-30', false) AS same_day FROM c LEFT JOIN i ON c.lead_id = i.lead_id LEFT JOIN g ON c.domain = g.domain
""")
def lead_feedback(spark: SparkSession, d: str) -> DataFrame:
    leads = table(spark, d, "customer").select(F.col("c_custkey").alias("lead_id"), F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("domain"))
    e = table(spark, d, "events").where("event_type in ('purchase', 'error')")
    feedback = e.select(F.col("user_id").alias("lead_id"), F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("domain"), F.col("event_type").alias("status"), F.col("ts").alias("time"), F.col("event_id").alias("seq"))
    out = pipeline.with_feedback(leads, feedback, F.lit("2024-01-30").cast("date"))
    return out.select("lead_id", F.col("feedback.status").alias("status"), "same_day")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2, 3""")
def hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type").withColumn("value", F.round("value", 4))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s
""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import sessions

    return sessions(table(spark, d, "events"), "ts", "user_id")


@query()
def change_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Steps of a change cycle over blocked responses, portals and unscored leads."""
    from ..operators import aggregate
    from .kpi_queries import RATES, kpi_counts_of, kpi_flags

    def measure(df: DataFrame) -> DataFrame:
        r = aggregate.rates(kpi_counts_of(kpi_flags(df)), RATES)
        return r.withColumn("progress", F.bround(0.5 * F.col("solo_rate") + 0.5 * (1 - F.col("bad_domain_mix")), 12))

    candidates = [("blocked", lambda x: x.where("coalesce(url_status, '') <> 'BLOCKED'")), ("portals", lambda x: x.where("not coalesce(startswith(lower(trim(domain)), 'portal'), false)")), ("unscored", lambda x: x.where("lead_score > 0"))]
    steps = pipeline.change_cycle(table(spark, d, "leads"), candidates, measure, lambda b, a: a["city_missing_rate"] <= b["city_missing_rate"] + 0.02, stop_after=3)
    return spark.createDataFrame([(i, s.name, s.passed, s.progress, s.accepted) for i, s in enumerate(steps)], "step int, name string, passed boolean, progress double, accepted boolean")
