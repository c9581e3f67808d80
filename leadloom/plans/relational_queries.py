"""Queries of keep-one, join, ranking, set and generation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..operators import dedupe, filters, generate, joins, rank
from ..session import table
from .registry import query


@query("""SELECT lead_id, domain, lead_score FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY coalesce(lead_score, 0) DESC, lead_id) AS n FROM leads) WHERE n = 1""")
def best_per_domain(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.keep_best(table(spark, d, "leads"), [F.col("domain")], F.col("lead_score"), F.col("lead_id")).select("lead_id", "domain", "lead_score")


@query(r"""
WITH t AS (SELECT lead_id, lead_score, coalesce(url, '') AS k1, CASE WHEN coalesce(store_name, '') <> '' THEN lower(store_name) || '|' || lower(coalesce(city, '')) ELSE '' END AS k2 FROM leads),
a AS (SELECT lead_id, row_number() OVER (PARTITION BY k1 ORDER BY coalesce(lead_score, 0) DESC, lead_id) AS n FROM t WHERE k1 <> ''),
b AS (SELECT lead_id, row_number() OVER (PARTITION BY k2 ORDER BY coalesce(lead_score, 0) DESC, lead_id) AS n FROM t WHERE k1 = '' AND k2 <> '')
SELECT lead_id FROM a WHERE n = 1 UNION ALL SELECT lead_id FROM b WHERE n = 1
""")
def best_two_keys(spark: SparkSession, d: str) -> DataFrame:
    """The best lead of each address, else of each name and city, which may be missing."""
    name, city = F.coalesce("store_name", F.lit("")), F.coalesce("city", F.lit(""))
    second = F.when(name != "", F.concat(F.lower(name), F.lit("|"), F.lower(city))).otherwise("")
    leads = table(spark, d, "leads")
    return dedupe.keep_best_two_keys(leads, F.coalesce("url", F.lit("")), second, F.col("lead_score"), F.col("lead_id")).select("lead_id")


@query("""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_per_user(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.keep_latest(table(spark, d, "events"), [F.col("user_id")], F.col("ts"), F.col("event_id")).select("user_id", "event_id", "ts")


@query(r"""
WITH k AS (SELECT line_id, lower(regexp_extract(trim(url, E' \t\n　'), '://([^/?#]*)', 1)) AS h FROM lead_lines)
SELECT line_id, h AS host FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY line_id) AS n FROM k WHERE h <> '') WHERE n = 1
""")
def first_per_host(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lead_lines").withColumn("host", urls.domain_plain(urls.strip(F.col("url"))))
    return dedupe.keep_first(lines, [F.col("host")], [F.col("line_id")], drop_blank=True).select("line_id", "host")


@query(r"""
WITH k AS (SELECT lead_id, lead_score, lower(trim(url)) AS u FROM leads WHERE coalesce(trim(url), '') <> ''),
p AS (SELECT *, min(lead_id) OVER (PARTITION BY u) AS position, row_number() OVER (PARTITION BY u ORDER BY coalesce(lead_score, 0) DESC, lead_id) AS n FROM k)
SELECT lead_id, position FROM p WHERE n = 1
""")
def keep_position(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.keep_position(table(spark, d, "leads"), F.lower(F.trim("url")), F.col("lead_score"), F.col("lead_id")).select("lead_id", "position")


@query(r"""
SELECT regexp_replace(lower(regexp_extract(trim(url, E' \t\n　'), '://([^/?#]*)', 1)), '^www\.', '') AS key, min(trim(url, E' \t\n　')) AS raw, count(DISTINCT trim(url, E' \t\n　')) AS n FROM lead_lines GROUP BY 1
""")
def smallest_spelling(spark: SparkSession, d: str) -> DataFrame:
    u = urls.strip(F.col("url"))
    return dedupe.smallest_raw(table(spark, d, "lead_lines"), F.regexp_replace(urls.domain_plain(u), r"^www\.", ""), u)


@query("""
SELECT domain, arg_max(city, lead_id) FILTER (WHERE coalesce(city, '') <> '') AS city, arg_max(phone, lead_id) FILTER (WHERE coalesce(phone, '') <> '') AS phone, arg_max(email, lead_id) FILTER (WHERE coalesce(email, '') <> '') AS email
FROM leads WHERE domain IS NOT NULL GROUP BY domain
""")
def merge_nonblank(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.merge_nonblank(table(spark, d, "leads").where("domain is not null"), "domain", ["city", "phone", "email"], "lead_id")


@query("""
WITH f AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0), g AS (SELECT min(c_custkey) AS k, c_mktsegment FROM f GROUP BY c_mktsegment),
h AS (SELECT f.* FROM f JOIN g ON f.c_custkey = g.k)
SELECT o.o_orderkey, coalesce(f.c_name, h.c_name) AS c_name, coalesce(f.c_custkey, h.c_custkey) AS c_custkey FROM (SELECT o_orderkey, o_custkey, 'BUILDING' AS seg FROM orders) o
LEFT JOIN f ON o.o_custkey = f.c_custkey LEFT JOIN h ON o.seg = h.c_mktsegment
""")
def fallback_join(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")
    firsts = known.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("c_custkey")).join(known.drop("c_mktsegment"), "c_custkey").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"))
    side = known.select("c_custkey", "c_name", F.lit(None).cast("string").alias("segment")).unionByName(firsts.select(F.lit(None).cast("bigint").alias("key"), "c_custkey", "c_name", "segment").drop("key"))
    # one partner for each value of each key: the fallback rows carry no customer key of their own
    by_key = side.where("segment is null").withColumn("key", F.col("c_custkey"))
    by_segment = side.where("segment is not null").withColumn("key", F.lit(None).cast("bigint"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit("BUILDING").alias("seg"))
    out = joins.fallback_join(orders, by_key.unionByName(by_segment), [("o_custkey", "key"), ("seg", "segment")], "partner")
    return out.select("o_orderkey", "partner.c_name", "partner.c_custkey")


LISTED = ["salon-mado.example", "portal00.example", "machi-reserve.example", "hair.example"]


@query("WITH l(dom) AS (VALUES " + ", ".join(f"('{x}')" for x in LISTED) + r"), t AS (SELECT lead_id, lower(trim(domain, E' \t')) AS x FROM leads WHERE domain IS NOT NULL) SELECT DISTINCT lead_id FROM t JOIN l ON x = dom OR ends_with(x, '.' || dom)")
def suffix_semi(spark: SparkSession, d: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in LISTED], "dom string")
    leads = table(spark, d, "leads").where("domain is not null").select("lead_id", F.lower(urls.strip(F.col("domain"))).alias("x"))
    return joins.suffix_semi(leads, F.col("x"), listed, "dom").select("lead_id")


@query("WITH l(dom) AS (VALUES " + ", ".join(f"('{x}')" for x in LISTED) + r"), t AS (SELECT lead_id, lower(trim(domain, E' \t')) AS x FROM leads WHERE domain IS NOT NULL) SELECT lead_id FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE x = dom OR ends_with(x, '.' || dom))")
def suffix_anti(spark: SparkSession, d: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in LISTED], "dom string")
    leads = table(spark, d, "leads").where("domain is not null").select("lead_id", F.lower(urls.strip(F.col("domain"))).alias("x"))
    return joins.suffix_semi(leads, F.col("x"), listed, "dom", anti=True).select("lead_id")


@query(r"""
WITH a AS (SELECT DISTINCT lower(trim(domain, E' \t')) AS a FROM leads WHERE coalesce(trim(domain, E' \t'), '') <> ''), b AS (SELECT DISTINCT domain AS b FROM site_names WHERE domain IS NOT NULL)
SELECT a, b FROM a JOIN b ON a = b OR ends_with(a, '.' || b) OR ends_with(b, '.' || a)
""")
def either_way_suffix(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "leads").select(F.lower(urls.strip(F.col("domain"))).alias("a")).where("coalesce(a, '') <> ''").distinct()
    b = table(spark, d, "site_names").select(F.col("domain").alias("b")).where("b is not null").distinct()
    left, right = a.withColumn("da", F.col("a")), b.withColumn("db", F.col("b"))
    return joins.either_way_suffix(left, right, "a", "da", "b", "db")


@query(r"""SELECT page_id FROM city_pages WHERE url IS NULL OR regexp_replace(lower(url), '/+$', '') = '' OR regexp_replace(lower(url), '/+$', '') NOT IN (SELECT regexp_replace(lower(website), '/+$', '') FROM site_names WHERE website IS NOT NULL AND name_confidence = 'high')""")
def unseen_pages(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.regexp_replace(F.lower(c), r"/+\z", "")
    old = table(spark, d, "site_names").where("name_confidence = 'high'")
    return joins.unseen(table(spark, d, "city_pages"), key(F.col("url")), old, key(F.col("website"))).select("page_id")


@query("""
WITH f AS (SELECT domain, source_query, min(lead_id) AS seen FROM leads WHERE domain IS NOT NULL GROUP BY 1, 2)
SELECT domain, list(source_query ORDER BY seen)[1] AS first_value, list(source_query ORDER BY seen)[1:3] AS values FROM f GROUP BY domain
""")
def source_queries(spark: SparkSession, d: str) -> DataFrame:
    return joins.first_sources(table(spark, d, "leads").where("domain is not null"), "domain", "source_query", "lead_id")


@query("""
WITH s AS (SELECT user_id AS id, arg_max(event_type, event_id) AS status FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1), r AS (SELECT user_id AS id, arg_max(event_type, event_id) AS review FROM events WHERE event_type = 'click' GROUP BY 1),
l AS (SELECT user_id AS id, max(value) AS value FROM events GROUP BY 1)
SELECT c_custkey, coalesce(s.status, r.review, 'none') AS status, l.value FROM customer LEFT JOIN s ON c_custkey = s.id LEFT JOIN r ON c_custkey = r.id LEFT JOIN l ON c_custkey = l.id
""")
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    # one pass over the events for the three lookups
    by = events.groupBy("user_id").agg(
        F.max_by("event_type", F.when(F.col("event_type").isin("purchase", "error"), F.col("event_id"))).alias("status"),
        F.max_by("event_type", F.when(F.col("event_type") == "click", F.col("event_id"))).alias("review"), F.max("value").alias("value"),
    )
    return table(spark, d, "customer").join(by, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", F.coalesce("status", "review", F.lit("none")).alias("status"), "value")


@query("""SELECT lead_id, run_id, domain, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id, domain ORDER BY lead_score DESC NULLS LAST, lead_id) AS rank FROM leads WHERE domain IS NOT NULL) WHERE rank <= 3""")
def top_per_domain(spark: SparkSession, d: str) -> DataFrame:
    leads = table(spark, d, "leads").where("domain is not null")
    out = rank.top_k(leads, [F.col("run_id"), F.col("domain")], [F.col("lead_score").desc_nulls_last(), F.col("lead_id")], 3)
    return out.select("lead_id", "run_id", "domain", F.col("rank").cast("int").alias("rank"))


@query("""
WITH r AS (SELECT lead_id, url_status, row_number() OVER (PARTITION BY url_status ORDER BY lead_score DESC NULLS LAST, lead_id) AS n, count(*) OVER (PARTITION BY url_status) AS c FROM leads)
SELECT lead_id, url_status FROM r WHERE n <= greatest(1, floor(c * 0.25))
""")
def top_share(spark: SparkSession, d: str) -> DataFrame:
    leads = table(spark, d, "leads").select("lead_id", "url_status", "lead_score")
    return rank.top_share(leads, ["url_status"], [F.col("lead_score").desc_nulls_last(), F.col("lead_id")], 0.25).select("lead_id", "url_status")


@query("""
WITH r AS (SELECT lead_id, city, row_number() OVER (PARTITION BY city ORDER BY lead_score DESC NULLS LAST, lead_id) AS n, count(*) OVER (PARTITION BY city) AS c FROM leads)
SELECT lead_id, city, CAST(n AS INTEGER) AS rank FROM r WHERE n <= greatest(1, floor(c * 0.1))
""")
def top_share_of_city(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of each city's leads, also of those without a city."""
    leads = table(spark, d, "leads").select("lead_id", "city", "lead_score")
    return rank.top_share(leads, ["city"], [F.col("lead_score").desc_nulls_last(), F.col("lead_id")], 0.1).select("lead_id", "city", "rank")


@query("""
WITH k AS (SELECT c_nationkey, count(*) AS h FROM customer WHERE c_acctbal > 9000 GROUP BY 1), s AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer WHERE c_acctbal <= 9000)
SELECT c_custkey, s.c_nationkey FROM s LEFT JOIN k ON s.c_nationkey = k.c_nationkey WHERE n <= least(8 - coalesce(h, 0), 4)
""")
def pair_rescue(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return rank.rescue(c.where("c_acctbal > 9000"), c.where("c_acctbal <= 9000"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 8, 4).select("c_custkey", "c_nationkey")


@query("""
SELECT lead_id, sales_label, lead_score, row_number() OVER (ORDER BY CASE sales_label WHEN '○' THEN 2 WHEN '△' THEN 1 ELSE 0 END DESC, lead_score DESC NULLS LAST, lead_id) AS position FROM leads
""")
def label_rank(spark: SparkSession, d: str) -> DataFrame:
    leads = table(spark, d, "leads").select("lead_id", "sales_label", "lead_score")
    return rank.positions(leads, [rank.label_order(F.col("sales_label")).desc(), F.col("lead_score").desc_nulls_last(), F.col("lead_id")])


@query("""
WITH m AS (SELECT max(o_orderkey) AS top FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, lpad(CAST(top + row_number() OVER (ORDER BY o_orderkey) AS VARCHAR), CAST(greatest(8, len(CAST(top + row_number() OVER (ORDER BY o_orderkey) AS VARCHAR))) AS INTEGER), '0') AS new_id FROM orders, m WHERE o_orderstatus <> 'F'
""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = orders.where("o_orderstatus <> 'F'").select("o_orderkey")
    return rank.next_ids(new, orders.where("o_orderstatus = 'F'"), "o_orderkey", [F.col("o_orderkey")], 3000, 8)


@query("""
WITH r AS (SELECT user_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
i AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS g FROM r WHERE f)
SELECT user_id, min(n) AS first_at, count(*) AS length FROM i GROUP BY user_id, g
""")
def error_streaks(spark: SparkSession, d: str) -> DataFrame:
    out = rank.streaks(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error")
    return out.select("user_id", F.col("first_at").cast("bigint").alias("first_at"), "length")


@query("""
SELECT name, status, kind FROM (SELECT domain AS name, 'kept' AS status, 'lead' AS kind FROM leads WHERE url_status = 'OK' AND domain IS NOT NULL UNION SELECT domain, 'blocked', 'lead' FROM leads WHERE url_status = 'BLOCKED' AND domain IS NOT NULL
EXCEPT SELECT domain, 'blocked', 'lead' FROM leads WHERE url_status = 'OK')
""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    leads = table(spark, d, "leads")
    part = lambda cond, status: leads.where(cond).where("domain is not null").select(F.col("domain").alias("name"), F.lit(status).alias("status"), F.lit("lead").alias("kind"))
    union = part("url_status = 'OK'", "kept").union(part("url_status = 'BLOCKED'", "blocked")).distinct()
    return union.subtract(part("url_status = 'OK'", "blocked"))


@query("""SELECT domain FROM leads WHERE domain IS NOT NULL INTERSECT SELECT domain FROM city_pages""")
def shared_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").where("domain is not null").select("domain").intersect(table(spark, d, "city_pages").select("domain"))


TEMPLATES = ["{n_name} {segment} 個人", "{segment} {n_name}", "{n_name}  {segment} 予約", "{segment} -chain {n_name}"]


@query("""
WITH p AS (SELECT n_name, segment FROM nation, (SELECT DISTINCT c_mktsegment AS segment FROM customer)),
t AS (SELECT n_name, segment, o AS ord, trim(regexp_replace(replace(replace(x, '{n_name}', n_name), '{segment}', segment), '\\s+', ' ', 'g')) AS query FROM p, (VALUES """.replace("\\\\", "\\") + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TEMPLATES)) + """) AS v(o, x))
SELECT n_name, segment, CAST(ord AS INTEGER) AS ord, query, NOT contains(regexp_replace(' ' || lower(query) || ' ', ' -[^ ]+', ' ', 'g'), 'chain') AND (contains(query, '個人') OR contains(query, '予約')) AS wanted
FROM (SELECT *, row_number() OVER (PARTITION BY n_name, segment ORDER BY ord) AS n FROM t) WHERE n <= 3
""")
def query_generation(spark: SparkSession, d: str) -> DataFrame:
    dims = generate.pairs(table(spark, d, "nation").select("n_name"), table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct())
    made = generate.expand(dims, TEMPLATES, limit=3)
    return made.select("n_name", "segment", "ord", "query", generate.allowed(F.col("query"), ["chain"], [["個人", "予約"]]).alias("wanted"))


@query("""
WITH p AS (SELECT DISTINCT city, business_type FROM leads WHERE city IS NOT NULL AND business_type IS NOT NULL), h AS (SELECT city, business_type, count(DISTINCT url) AS n_urls FROM leads WHERE url_status = 'BLOCKED' GROUP BY 1, 2)
SELECT p.city, p.business_type, coalesce(n_urls, 0) AS n_urls FROM p LEFT JOIN h ON p.city = h.city AND p.business_type = h.business_type WHERE coalesce(n_urls, 0) < 3
""")
def starved_pairs(spark: SparkSession, d: str) -> DataFrame:
    leads = table(spark, d, "leads")
    pairs = leads.where("city is not null and business_type is not null").select("city", "business_type").distinct()
    return generate.starved(pairs, leads.where("url_status = 'BLOCKED'"), ["city", "business_type"], 3)


@query("""
WITH k AS (SELECT lead_id, lead_score FROM leads WHERE lead_score >= 80), u AS (SELECT lead_id, lead_score, row_number() OVER (ORDER BY lead_score DESC, lead_id) AS n FROM leads WHERE lead_score BETWEEN 60 AND 79), c AS (SELECT count(*) AS c FROM k)
SELECT lead_id, lead_score, 'kept' AS stage FROM k UNION ALL SELECT lead_id, lead_score, 'relaxed' FROM u, c WHERE n <= 2000 - c
""")
def recall_fallback(spark: SparkSession, d: str) -> DataFrame:
    leads = table(spark, d, "leads").select("lead_id", "lead_score")
    kept = leads.where(filters.in_range(F.col("lead_score"), 80))
    spare = rank.positions(leads.where(filters.in_range(F.col("lead_score"), 60, 79)), [F.desc("lead_score"), F.col("lead_id")])
    room = kept.agg((F.lit(2000) - F.count("*")).alias("room"))
    added = spare.crossJoin(F.broadcast(room)).where("position <= room")  # one row
    return kept.withColumn("stage", F.lit("kept")).unionByName(added.select("lead_id", "lead_score", F.lit("relaxed").alias("stage")))


FREE = rules.FREE_PLATFORMS


@query(r"""
WITH e AS (SELECT name_id, unnest(regexp_split_to_array(name_warning, '\s*[;；、]\s*')) AS w FROM site_names WHERE name_warning IS NOT NULL)
SELECT w AS item, count(*) AS n FROM (SELECT DISTINCT name_id, w FROM e WHERE w <> '') GROUP BY w
""")
def warning_counts(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.aggregate import exploded_counts

    names = table(spark, d, "site_names").where("name_warning is not null")
    items = F.filter(F.array_distinct(F.split("name_warning", r"\s*[;；、]\s*")), lambda w: w != "")
    return exploded_counts(names, items)


@query(r"""SELECT lead_id, CASE WHEN trim(store_name) <> '' THEN left('lf-' || regexp_replace(regexp_replace(lower(trim(store_name)), '[^\p{L}\p{M}\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g'), 59) END AS slug FROM (SELECT lead_id, regexp_replace(store_name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS store_name FROM leads WHERE store_name IS NOT NULL)""")
def lead_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of all named leads."""
    leads = table(spark, d, "leads").where(F.col("store_name").isNotNull())
    return leads.select("lead_id", F.when(urls.strip(F.col("store_name")) != "", urls.lead_slug(F.col("store_name"))).alias("slug"))


@query("""SELECT lead_id, CASE WHEN starts_with(lower(coalesce(email, '')), 'info@') THEN split_part(email, '@', 2) WHEN domain IS NOT NULL AND contains(lower(trim(domain)), '.') THEN 'domain' ELSE '' END AS contact FROM leads""")
def contact_kind(spark: SparkSession, d: str) -> DataFrame:
    mail = F.coalesce("email", F.lit(""))
    chain = [(F.lower(mail).startswith("info@"), F.substring_index(mail, "@", -1)), (F.contains(F.lower(F.trim("domain")), F.lit(".")), F.lit("domain"))]
    return table(spark, d, "leads").select("lead_id", rules.first_reason(chain).alias("contact"))
