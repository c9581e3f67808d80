"""Queries of record-level helpers, precedence merges, liveness fan-out, rollups and rule patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, rules, text, urls
from ..operators import aggregate, classify, dedupe, joins, rank
from ..session import table
from .registry import query


@query(r"""
SELECT lead_id, coalesce(regexp_matches(url, '^https?://[^/?#]+'), false) AS web, CASE WHEN contains(lower(trim(coalesce(domain, ''), E' \t')), '.') THEN 'domain' WHEN url IS NOT NULL THEN 'url' ELSE 'none' END AS source,
  lower(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '')) AS blob FROM leads
""")
def url_facts(spark: SparkSession, d: str) -> DataFrame:
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    source = F.when(urls.clean_domain(e("domain")) != "", "domain").when(urls.first_domain(e("domain"), e("url")) != "", "url").otherwise("none")
    return table(spark, d, "leads").select("lead_id", urls.is_web_url(F.col("url")).alias("web"), source.alias("source"), urls.blob(F.col("url")).alias("blob"))


@query(r"""
WITH t AS (SELECT page_id, lower(trim(domain)) AS a, regexp_replace(lower(regexp_extract(contact_url, '://([^/?#]*)', 1)), '^www\.', '') AS b FROM city_pages WHERE domain IS NOT NULL AND contact_url IS NOT NULL)
SELECT page_id, a <> '' AND b <> '' AND (a = b OR ends_with(a, '.' || b) OR ends_with(b, '.' || a)) AS same_site FROM t
""")
def contact_same_site(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "city_pages").where("domain is not null and contact_url is not null")
    return pages.select("page_id", urls.same_site(F.lower(F.trim("domain")), urls.domain_key(F.col("contact_url"))).alias("same_site"))


@query(r"""
SELECT page_id, CASE WHEN has_form THEN '1' WHEN NOT has_form THEN '0' ELSE '' END AS form, split_part(coalesce(contact_fetch_status, '') || ':' || coalesce(category_guess, ''), ':', 1) AS reason,
  CASE WHEN category_guess <> '' THEN category_guess END AS category, coalesce(regexp_matches(lower(coalesce(title, '')), '(^|[^a-z0-9])spa([^a-z0-9]|$)') OR contains(lower(coalesce(title, '')), 'salon'), false) AS token
FROM (SELECT *, regexp_replace(title, '', '') AS t2 FROM city_pages)
""")
def page_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.concat(F.lit("area=x | category="), e("category_guess"), F.lit(" | end=1"))
    return table(spark, d, "city_pages").select(
        "page_id", text.truth(F.col("has_form")).alias("form"), text.reason_key(F.concat(e("contact_fetch_status"), F.lit(":"), e("category_guess"))).alias("reason"),
        text.evidence(line, "category").alias("category"), text.token_match(e("title"), ["spa", "salon"]).alias("token"),
    )


CITIES = ["福羽市", "神晴市", "山都市", "長里市", "青白市", "大風市"]


@query("SELECT page_id, coalesce(" + ", ".join(f"CASE WHEN contains(address, '{c}') THEN '{c}' END" for c in CITIES) + ", nullif(area_guess, ''), 'unknown') AS city FROM city_pages")
def city_of_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "city_pages").select("page_id", F.coalesce(html.first_listed(F.col("address"), CITIES), F.when(F.col("area_guess") != "", F.col("area_guess")), F.lit("unknown")).alias("city"))


@query("""
WITH c AS (SELECT page_id, 0 AS o, address AS a, score + 20 AS s FROM city_pages WHERE coalesce(address, '') <> '' UNION ALL SELECT page_id, 1, contact_page_address, score + 10 + len(contact_page_address) FROM city_pages WHERE coalesce(contact_page_address, '') <> '')
SELECT page_id, a AS best FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY s DESC, o) AS n FROM c) WHERE n = 1
""")
def best_of_row(spark: SparkSession, d: str) -> DataFrame:
    """Best of several candidates of one row by the largest struct, without any shuffle."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    first = F.when(filled("address"), F.struct((F.col("score") + 20).alias("s"), F.lit(0).alias("o"), F.col("address").alias("a")))
    second = F.when(filled("contact_page_address"), F.struct((F.col("score") + 10 + F.length("contact_page_address")).alias("s"), F.lit(-1).alias("o"), F.col("contact_page_address").alias("a")))
    best = F.array_max(F.array_compact(F.array(first, second)))
    return table(spark, d, "city_pages").select("page_id", best["a"].alias("best")).where("best is not null")


@query("""
WITH u AS (SELECT url, max(http_status) AS s FROM leads WHERE url IS NOT NULL GROUP BY url) SELECT lead_id, coalesce(NOT (u.s IN (404, 410) OR u.s >= 500), false) AS alive FROM leads LEFT JOIN u ON leads.url = u.url
""")
def liveness_by_url(spark: SparkSession, d: str) -> DataFrame:
    leads = table(spark, d, "leads")
    checked = leads.where("url is not null").groupBy("url").agg(F.max("http_status").alias("status"))  # one check for each address
    return leads.select("lead_id", "url").join(checked, "url", "left").select("lead_id", classify.alive(F.col("status")).alias("alive"))


@query("""
SELECT run_id, url_status, count(*) AS n, count(*) FILTER (WHERE http_status = 200) AS alive, count(DISTINCT domain) AS domains, CAST(count(phone) * 100 // count(*) AS BIGINT) AS phone_percent FROM leads GROUP BY ROLLUP (run_id, url_status)
""")
def run_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").rollup("run_id", "url_status").agg(
        F.count("*").alias("n"), F.count_if(F.col("http_status") == 200).alias("alive"), F.count_distinct("domain").alias("domains"), F.expr("count(phone) * 100 div count(*)").alias("phone_percent")
    )


@query("""
WITH s AS (SELECT lead_id AS id, domain AS dom, 0 AS prec, lead_id AS seq FROM leads WHERE url_status = 'OK' AND domain IS NOT NULL UNION ALL SELECT page_id, domain, 1, page_id FROM city_pages WHERE domain IS NOT NULL UNION ALL SELECT name_id, domain, 2, name_id FROM site_names WHERE domain IS NOT NULL)
SELECT dom, id, prec FROM (SELECT *, row_number() OVER (PARTITION BY dom ORDER BY prec, seq) AS n FROM s) WHERE n = 1
""")
def source_precedence(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, i, n, cond="true": table(spark, d, t).where(f"domain is not null and {cond}").select(F.col(i).alias("id"), F.col("domain").alias("dom"), F.lit(n).alias("prec"))
    every = part("leads", "lead_id", 0, "url_status = 'OK'").unionByName(part("city_pages", "page_id", 1)).unionByName(part("site_names", "name_id", 2))
    return dedupe.keep_first(every, [F.col("dom")], [F.col("prec"), F.col("id")]).select("dom", "id", "prec")


@query("""
WITH b AS (SELECT domain, count(*) AS n FROM leads WHERE domain IS NOT NULL AND coalesce(lead_score, 0) < 30 AND contains(domain, '.') GROUP BY domain), t AS (SELECT * FROM b ORDER BY n DESC, domain LIMIT 5)
SELECT lead_id FROM leads WHERE domain IS NULL OR domain NOT IN (SELECT domain FROM t)
""")
def patched_filter(spark: SparkSession, d: str) -> DataFrame:
    """A rule set extended by the most frequent bad domains, and the rows that the new rules keep."""
    leads = table(spark, d, "leads")
    worst = leads.where("domain is not null and coalesce(lead_score, 0) < 30 and contains(domain, '.')").groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(5)
    added = [rules.Rule(r.domain) for r in worst.collect()]  # at most five
    listed = rules.as_table(spark, rules.patched([], added))
    return joins.unseen(leads, F.col("domain"), listed, F.col("pattern")).select("lead_id")


@query("""
WITH l AS (SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS loop, value AS theta, event_type = 'purchase' AS improved, event_type <> 'error' AS passed FROM events)
SELECT run, loop, theta FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN improved THEN 0 WHEN passed THEN 1 ELSE 2 END, CASE WHEN improved THEN -theta END, CASE WHEN improved OR passed THEN loop ELSE -loop END) AS n FROM l) WHERE n = 1
""")
def chosen_loop(spark: SparkSession, d: str) -> DataFrame:
    """The loop of each run that counts: the best improved one, else the first that passed, else the last."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    loops = table(spark, d, "events").select(F.col("user_id").alias("run"), F.row_number().over(w).alias("loop"), F.col("value").alias("theta"), (F.col("event_type") == "purchase").alias("improved"), (F.col("event_type") != "error").alias("passed"))
    order = [F.when(F.col("improved"), 0).when(F.col("passed"), 1).otherwise(2), F.when(F.col("improved"), -F.col("theta")), F.when(F.col("improved") | F.col("passed"), F.col("loop")).otherwise(-F.col("loop"))]
    return dedupe.keep_first(loops, [F.col("run")], order).select("run", "loop", "theta")


@query("""
WITH b AS (SELECT lead_id, CASE WHEN lead_score >= 70 THEN 0 WHEN lead_score IS NULL THEN 2 ELSE 1 END AS bucket, lead_score FROM leads), c AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY lead_score DESC, lead_id) AS r FROM b)
SELECT lead_id, CAST(bucket AS INTEGER) AS bucket, bucket = 0 AND r <= 100 AS checked FROM c
""")
def checked_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Buckets in fixed order, of the first of which the best hundred are marked for checking."""
    score = F.col("lead_score")
    b = table(spark, d, "leads").select("lead_id", F.when(score >= 70, 0).when(score.isNull(), 2).otherwise(1).cast("int").alias("bucket"), "lead_score")
    first = rank.top_k(b.where("bucket = 0"), [F.lit(0)], [F.desc("lead_score"), F.col("lead_id")], 100).select("lead_id", F.lit(True).alias("checked"))
    return b.join(first, "lead_id", "left").select("lead_id", "bucket", F.coalesce("checked", F.lit(False)).alias("checked"))


@query("""
SELECT r_name AS region, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers, round(avg(c_acctbal), 4) AS average FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY r_name
""")
def geography(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    both = places.join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return both.groupBy(F.col("r_name").alias("region")).agg(F.count_distinct("n_nationkey").alias("nations"), F.count("c_custkey").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("average"))


@query("""
WITH p AS (SELECT l_orderkey, arg_max(l_partkey, l_extendedprice) AS top_part, max(l_extendedprice) AS top_price, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey)
SELECT o_orderstatus AS status, count(*) AS orders, round(sum(quantity), 2) AS quantity, round(max(top_price), 2) AS top_price FROM orders JOIN p ON o_orderkey = l_orderkey GROUP BY 1
""")
def order_summary(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("top_price"), F.sum("l_quantity").alias("quantity"))
    both = table(spark, d, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("orders"), F.round(F.sum("quantity"), 2).alias("quantity"), F.round(F.max("top_price"), 2).alias("top_price"))


@query("""
SELECT lead_id, solo_classification IN ('solo', 'small') AS in_class, coalesce(lead_score >= 40 AND lead_score <= 90, false) OR url_status <> 'OK' AS in_range, CASE WHEN coalesce(solo_score, 0) = -999 THEN 0 ELSE greatest(0, least(100, coalesce(solo_score, 0) * 10)) END AS solo_100 FROM leads
""")
def lead_ranges(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.filters import in_range

    solo = F.coalesce("solo_score", F.lit(0))
    return table(spark, d, "leads").select(
        "lead_id", F.col("solo_classification").isin("solo", "small").alias("in_class"), in_range(F.col("lead_score"), 40, 90, F.col("url_status") != "OK").alias("in_range"),
        F.when(solo == -999, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), solo * 10))).alias("solo_100"),
    )


@query("""
WITH w AS (SELECT name_id, len(regexp_split_to_array(regexp_replace(display_name, '^[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+|[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+$', '', 'g'), '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+')) AS words, name_confidence AS c FROM site_names WHERE display_name IS NOT NULL)
SELECT coalesce(c, 'none') AS confidence, CAST(least(words, 4) AS INTEGER) AS words, count(*) AS n FROM w GROUP BY 1, 2
""")
def name_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Names by confidence and number of words between Unicode white space."""
    t = table(spark, d, "site_names").where(F.col("display_name").isNotNull())
    words = F.least(F.size(F.split(urls.strip(F.col("display_name")), r"(?U)\s+")), F.lit(4)).cast("int")
    return t.groupBy(F.coalesce("name_confidence", F.lit("none")).alias("confidence"), words.alias("words")).agg(F.count("*").alias("n"))


@query("""SELECT domain AS value, count(*) AS count FROM city_pages WHERE domain IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, min(page_id) LIMIT 10""")
def frequent_domains(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.top_counts(table(spark, d, "city_pages"), F.col("domain"), F.col("page_id"))
