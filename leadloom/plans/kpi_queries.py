"""Queries of counts, rates, gates, scorecards, pages and names, and the flagship pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, rules, urls
from ..operators import aggregate, classify, dedupe, rank
from ..session import table
from .registry import query

KPI_SQL = """
SELECT count(*) AS total, count(*) FILTER (WHERE noise) AS noise, count(*) FILTER (WHERE pos) AS positive, count(*) FILTER (WHERE pos AND cls IN ('solo', 'small')) AS solo, count(*) FILTER (WHERE pos AND cls = 'corporate') AS corporate,
  count(*) FILTER (WHERE pos AND cls NOT IN ('solo', 'small', 'corporate')) AS unknown, count(*) FILTER (WHERE pos AND city_missing) AS city_missing FROM (
  SELECT *, s > 0 AND NOT noise AS pos FROM (SELECT coalesce(lead_score, 0) AS s, coalesce(nullif(solo_classification, ''), 'unknown') AS cls, regexp_replace(coalesce(city, ''), '[\\s\\x{3000}]', '', 'g') = '' AS city_missing,
    coalesce(ends_with(lower(trim(domain)), '.example') AND starts_with(regexp_replace(lower(trim(domain)), '^www\\.', ''), 'portal'), false) AS noise FROM leads{where}))
"""


def kpi_flags(leads: DataFrame) -> DataFrame:
    """Flags of a lead for the KPIs: noise, positive, class, missing city."""
    dom = F.lower(F.trim("domain"))
    noise = F.coalesce(dom.endswith(".example") & F.regexp_replace(dom, r"^www\.", "").startswith("portal"), F.lit(False))
    out = leads.select("lead_id", "domain", F.coalesce("lead_score", F.lit(0)).alias("s"), F.when(F.col("solo_classification") != "", F.col("solo_classification")).alias("cls0"),
                       (F.regexp_replace(F.coalesce("city", F.lit("")), r"(?U)\s", "") == "").alias("city_missing"), noise.alias("noise"))
    out = out.withColumn("cls", F.coalesce("cls0", F.lit("unknown"))).drop("cls0")
    return out.withColumn("pos", (F.col("s") > 0) & ~F.col("noise"))


def kpi_counts_of(flags: DataFrame) -> DataFrame:
    pos, cls = F.col("pos"), F.col("cls")
    return aggregate.conditional_counts(flags, {
        "total": F.lit(True), "noise": F.col("noise"), "positive": pos, "solo": pos & cls.isin("solo", "small"), "corporate": pos & (cls == "corporate"),
        "unknown": pos & ~cls.isin("solo", "small", "corporate"), "city_missing": pos & F.col("city_missing"),
    })


RATES = {"solo_rate": ("solo", "positive"), "corporate_rate": ("corporate", "positive"), "unknown_rate": ("unknown", "positive"), "city_missing_rate": ("city_missing", "positive"), "bad_domain_mix": ("noise", "total")}
RATES_SQL = ", ".join(f"CASE WHEN {b} > 0 THEN round_even({a} / {b}, 6) ELSE 0.0 END AS {n}" for n, (a, b) in RATES.items())


@query(KPI_SQL.replace("{where}", ""))
def kpi_counts(spark: SparkSession, d: str) -> DataFrame:
    return kpi_counts_of(kpi_flags(table(spark, d, "leads")))


@query(f"SELECT {RATES_SQL} FROM (" + KPI_SQL.replace("{where}", "") + ")")
def kpi_rates(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.rates(kpi_counts_of(kpi_flags(table(spark, d, "leads"))), RATES).select(*RATES)


@query("""
WITH r AS (SELECT lead_id, url_status, city, lead_score, row_number() OVER (ORDER BY lead_score DESC NULLS LAST, domain, lead_id) AS n FROM leads)
SELECT count(*) FILTER (WHERE url_status = 'OK') AS good, count(*) FILTER (WHERE url_status <> 'OK') AS bad, count(*) FILTER (WHERE coalesce(city, '') = '') AS city_missing FROM r WHERE n <= 50
""")
def kpi_top50(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "leads").select("lead_id", "url_status", "city", "lead_score", "domain").orderBy(F.col("lead_score").desc_nulls_last(), F.col("domain").asc_nulls_last(), "lead_id").limit(50)
    return aggregate.conditional_counts(top, {"good": F.col("url_status") == "OK", "bad": F.col("url_status") != "OK", "city_missing": F.coalesce("city", F.lit("")) == ""})


@query("""SELECT domain AS value, count(*) AS count FROM leads WHERE domain IS NOT NULL AND url_status <> 'OK' GROUP BY 1 ORDER BY 2 DESC, min(lead_id) LIMIT 10""")
def top_bad_domains(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.top_counts(table(spark, d, "leads").where("url_status <> 'OK'"), F.col("domain"), F.col("lead_id"), 10)


@query("""SELECT run_id, list(lead_id ORDER BY lead_id)[1:5] AS examples FROM leads WHERE coalesce(city, '') = '' GROUP BY run_id""")
def missing_city_examples(spark: SparkSession, d: str) -> DataFrame:
    missing = table(spark, d, "leads").where("coalesce(city, '') = ''")
    return aggregate.examples(missing, ["run_id"], F.col("lead_id"), F.col("lead_id"), 5)


@query("""
SELECT CAST(s AS INTEGER) AS stage, name, n FROM (SELECT 0 AS s, 'collected' AS name, count(*) AS n FROM leads UNION ALL SELECT 1, 'with_url', count(*) FILTER (WHERE url <> '') FROM leads
UNION ALL SELECT 2, 'reachable', count(*) FILTER (WHERE url <> '' AND url_status = 'OK') FROM leads UNION ALL SELECT 3, 'scored', count(*) FILTER (WHERE url <> '' AND url_status = 'OK' AND lead_score >= 40) FROM leads)
""")
def search_funnel(spark: SparkSession, d: str) -> DataFrame:
    stages = [("collected", F.lit(True)), ("with_url", F.col("url") != ""), ("reachable", F.col("url_status") == "OK"), ("scored", F.col("lead_score") >= 40)]
    return aggregate.funnel(table(spark, d, "leads"), stages)


GATES = """
WITH b AS (SELECT """ + RATES_SQL + " FROM (" + KPI_SQL.replace("{where}", "") + ")), a AS (SELECT " + RATES_SQL + " FROM (" + KPI_SQL.replace("{where}", " WHERE coalesce(url_status, '') <> 'BLOCKED'") + """)),
g AS (SELECT a.bad_domain_mix <= b.bad_domain_mix AS bad_mix, a.city_missing_rate <= b.city_missing_rate AS city_missing, a.solo_rate >= b.solo_rate AS solo, b.* FROM a, b)
SELECT bad_mix, city_missing, solo, bad_mix AND city_missing AND solo AS passed, list_filter([CASE WHEN NOT bad_mix THEN 'bad_mix' END, CASE WHEN NOT city_missing THEN 'city_missing' END, CASE WHEN NOT solo THEN 'solo' END], lambda x: x IS NOT NULL) AS failed,
  round_even(0.4 * solo_rate + 0.2 * (1 - corporate_rate) + 0.25 * (1 - unknown_rate) + 0.15 * (1 - bad_domain_mix), 12) AS progress FROM g
"""


@query(GATES)
def change_gates(spark: SparkSession, d: str) -> DataFrame:
    leads = table(spark, d, "leads")
    rate = lambda df: aggregate.rates(kpi_counts_of(kpi_flags(df)), RATES).select(*RATES)
    both = aggregate.compare(rate(leads), rate(leads.where("coalesce(url_status, '') <> 'BLOCKED'")))
    b, a = (lambda n: F.col(f"before.{n}")), (lambda n: F.col(f"after.{n}"))
    out = aggregate.gates(both, {"bad_mix": a("bad_domain_mix") <= b("bad_domain_mix"), "city_missing": a("city_missing_rate") <= b("city_missing_rate"), "solo": a("solo_rate") >= b("solo_rate")})
    progress = F.bround(0.4 * b("solo_rate") + 0.2 * (1 - b("corporate_rate")) + 0.25 * (1 - b("unknown_rate")) + 0.15 * (1 - b("bad_domain_mix")), 12)
    return out.select("bad_mix", "city_missing", "solo", "passed", "failed", progress.alias("progress"))


@query("""
WITH t AS (SELECT lead_id, coalesce(lead_score, 0) + CASE WHEN starts_with(url, 'https://') THEN 5 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 10 ELSE 0 END
  + CASE WHEN coalesce(city, '') = '' THEN -15 ELSE 0 END + CASE WHEN site_type IN ('blog', 'builder') THEN 8 ELSE 0 END + CASE WHEN solo_score = -999 THEN -40 ELSE 0 END AS s,
  list_filter([CASE WHEN starts_with(url, 'https://') THEN 'https' END, CASE WHEN phone IS NOT NULL THEN 'phone' END, CASE WHEN email IS NOT NULL THEN 'email' END, CASE WHEN coalesce(city, '') = '' THEN 'no_city' END,
    CASE WHEN site_type IN ('blog', 'builder') THEN 'simple_site' END, CASE WHEN solo_score = -999 THEN 'corporate' END], lambda x: x IS NOT NULL) AS reasons FROM leads)
SELECT lead_id, CAST(greatest(0, least(100, s)) AS INTEGER) AS score, reasons, CASE WHEN greatest(0, least(100, s)) >= 60 THEN 'A' WHEN greatest(0, least(100, s)) >= 40 THEN 'B' ELSE 'C' END AS grade FROM t
""")
def lead_scorecard(spark: SparkSession, d: str) -> DataFrame:
    card = [(F.col("url").startswith("https://"), 5, "https"), (F.col("phone").isNotNull(), 10, "phone"), (F.col("email").isNotNull(), 10, "email"), (F.coalesce("city", F.lit("")) == "", -15, "no_city"),
            (F.col("site_type").isin("blog", "builder"), 8, "simple_site"), (F.col("solo_score") == -999, -40, "corporate")]
    score, why = rules.scorecard(card, F.coalesce("lead_score", F.lit(0)), 0, 100)
    return table(spark, d, "leads").select("lead_id", score.alias("score"), why.alias("reasons"), classify.grade(score).alias("grade"))


WORDS = [rules.Rule("theorem", "", 4), rules.Rule("\\begin{thm}", "", 6), rules.Rule("\\cite", "", 3), rules.Rule("figure", "", 5), rules.Rule("tabular", "", -4)]


@query("SELECT doc_id, CAST(least(12, " + " + ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{r.pattern}') THEN {r.points} ELSE 0 END" for r in WORDS) + ") AS INTEGER) AS points, CASE " + " ".join(f"WHEN contains(lower(text), '{r.pattern}') THEN '{r.pattern}'" for r in WORDS) + " END AS first_word FROM documents")
def capped_points(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", rules.points(t, WORDS, cap=12).cast("int").alias("points"), rules.first_match(t, WORDS).alias("first_word"))


PAGE = ("<html><head><title>", "</title><meta property=\"og:site_name\" content=\"", "\"><style>p{}</style></head><body><h1>", "</h1><p>", "</p><a href=\"/contact\">x</a><a href=\"tel:03-0001-2345\">t</a><script>var a=1</script></body></html>")


def as_pages(df: DataFrame) -> DataFrame:
    """Pages made of the columns of city_pages, with title, site name, heading, address and links."""
    e = lambda c: F.coalesce(c, F.lit(""))
    page = F.concat(F.lit(PAGE[0]), e("title"), F.lit(PAGE[1]), e("display_name"), F.lit(PAGE[2]), e("display_name"), F.lit(PAGE[3]), e("address"), F.lit(PAGE[4]))
    return df.select("page_id", "url", "title", "display_name", "address", page.alias("html"))


ONE = "trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


@query(f"""
SELECT page_id, {ONE.format(x="coalesce(title, '')")} AS page_title, {ONE.format(x="coalesce(display_name, '')")} AS heading, coalesce(display_name, '') AS site_name, '03-0001-2345' AS phone,
  CAST(len({ONE.format(x="coalesce(title, '') || ' ' || coalesce(display_name, '') || ' ' || coalesce(address, '') || ' x t'")}) AS INTEGER) AS text_length FROM city_pages
""")
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return as_pages(table(spark, d, "city_pages")).select(
        "page_id", html.element(h, "title").alias("page_title"), html.element(h, "h1").alias("heading"), html.meta(h, "og:site_name").alias("site_name"), html.phone_link(h).alias("phone"), F.length(html.bare_text(h)).alias("text_length")
    )


BODY = ONE.format(x="coalesce(title, '') || ' ' || coalesce(display_name, '') || ' ' || coalesce(address, '') || ' x t'")


@query(f"""SELECT page_id, contains(lower({BODY}), 'salon') OR contains(lower({BODY}), 'サロン') AS salon, contains(lower({BODY}), '市') AS place, CAST(len(lower({BODY})) AS INTEGER) AS text_length, len(lower({BODY})) < 60 AS thin FROM city_pages""")
def page_signals(spark: SparkSession, d: str) -> DataFrame:
    return as_pages(table(spark, d, "city_pages")).select("page_id", *html.signals(F.col("html"), {"salon": ["salon", "サロン"], "place": ["市"]}, thin=60))


@query(f"""
SELECT page_id, coalesce(CASE WHEN len({ONE.format(x="display_name")}) BETWEEN 1 AND 60 THEN {ONE.format(x="display_name")} END, CASE WHEN len(trim(split_part(regexp_replace({ONE.format(x="coalesce(title, '')")}, '｜', '|', 'g'), '|', 1))) BETWEEN 1 AND 60 THEN trim(split_part(regexp_replace({ONE.format(x="coalesce(title, '')")}, '｜', '|', 'g'), '|', 1)) END, 'Unknown') AS name,
  coalesce(CASE WHEN c <> '' THEN c[1:3] || '-' || c[-4:] ELSE '' END, '') AS postal
FROM (SELECT *, regexp_extract(' ' || translate(coalesce(address, ''), '０１２３４５６７８９－‐−', '0123456789---') || ' ', '(?:〒\\s*|[^0-9-])([0-9]{{3}}-?[0-9]{{4}})[^0-9-]', 1) AS c FROM city_pages)
""")
def page_names(spark: SparkSession, d: str) -> DataFrame:
    pages = as_pages(table(spark, d, "city_pages"))
    return pages.select("page_id", html.name_chain(F.col("html"), F.lit("")).alias("name"), html.postal_code(F.coalesce("address", F.lit(""))).alias("postal"))


@query(f"""
SELECT page_id, {ONE.format(x="coalesce(title, '') || ' ' || coalesce(display_name, '') || ' ' || coalesce(address, '') || ' x t'")} AS text,
  CASE WHEN url IS NULL THEN CAST([] AS VARCHAR[]) ELSE [regexp_extract(url, '^(https?://[^/]+)', 1) || '/contact'] END AS links FROM city_pages
""")
def page_reader(spark: SparkSession, d: str) -> DataFrame:
    read = html.read_pages(as_pages(table(spark, d, "city_pages")), "page_id")
    return read.select("page_id", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("text"), "links")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Best lead of each shop with score, reasons, grade and label order: filter, score, keep best, rank."""
    leads = table(spark, d, "leads").where("url_status = 'OK'")
    dom = urls.clean_domain(F.coalesce("domain", F.lit("")))
    card = [(F.col("url").startswith("https://"), 5, "https"), (F.col("phone").isNotNull(), 10, "phone"), (F.coalesce("city", F.lit("")) == "", -15, "no_city")]
    score, why = rules.scorecard(card, F.coalesce("lead_score", F.lit(0)), 0, 100)
    scored = leads.select("lead_id", dom.alias("site"), "store_name", "city", "sales_label", score.alias("score"), F.array_join(why, "; ").alias("reasons"))
    name = F.coalesce("store_name", F.lit(""))
    # without site and name nothing tells that two leads are one: each stands for itself
    alone = F.when((F.col("site") == "") & (name == ""), F.col("lead_id"))
    best = dedupe.keep_best(scored, [F.col("site"), name, alone], F.col("score"), F.col("lead_id"))
    return best.withColumns({"grade": classify.grade(F.col("score")), "label_order": rank.label_order(F.col("sales_label"))})


FLAGSHIP = r"""
WITH t AS (SELECT lead_id, lower(trim(coalesce(domain, ''), E' \t\r\n　')) AS v, store_name, city, sales_label, greatest(0, least(100, coalesce(lead_score, 0) + CASE WHEN starts_with(url, 'https://') THEN 5 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN coalesce(city, '') = '' THEN -15 ELSE 0 END)) AS s,
  array_to_string(list_filter([CASE WHEN starts_with(url, 'https://') THEN 'https' END, CASE WHEN phone IS NOT NULL THEN 'phone' END, CASE WHEN coalesce(city, '') = '' THEN 'no_city' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM leads WHERE url_status = 'OK'),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(v, ':.*$', ''), '^\.+|\.+$', '', 'g'), '^www\.', '') AS x FROM t),
k AS (SELECT *, CASE WHEN contains(x, '.') THEN x ELSE '' END AS site FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY site, coalesce(store_name, ''), CASE WHEN site = '' AND coalesce(store_name, '') = '' THEN lead_id END ORDER BY s DESC, lead_id) AS n FROM k)
SELECT lead_id, site, store_name, city, sales_label, CAST(s AS INTEGER) AS score, reasons, CASE WHEN s >= 60 THEN 'A' WHEN s >= 40 THEN 'B' ELSE 'C' END AS grade, CAST(CASE sales_label WHEN '○' THEN 2 WHEN '△' THEN 1 ELSE 0 END AS INTEGER) AS label_order FROM r WHERE n = 1
"""
query(FLAGSHIP)(flagship)
