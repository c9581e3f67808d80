"""Queries of page fields, links, composite flows and appends, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, page, text, urls
from ..operators import aggregate, classify, joins
from ..session import table
from ..sources import sinks
from . import flows
from .kpi_queries import RATES, kpi_flags
from .registry import query
from .url_queries import CLEAN, NET, ONE_SPACE, PATH, SHEET, TRIM

SITES = ["福羽市", "神晴市", "山都市"]


def lead_pages(leads: DataFrame) -> DataFrame:
    """Pages made of the columns of leads: author, logo, heading, owner, telephone, addresses, links and footer."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    source = F.concat(
        F.lit("<html><head><title>"), e("store_name"), F.lit('</title><meta name="author" content="'), e("business_type"), F.lit('"></head><body><header>x</header><main><h1>'), e("display_name"), F.lit("</h1><p>"),
        e("source_query"), F.lit("</p><p>"), e("phone"), F.lit('</p></main><a href="mailto:'), e("email"), F.lit('?subject=a">m</a><p>info@example.jp, shop'), F.col("lead_id").cast("string"),
        F.lit('@mail.example</p><a href="https://other.example/contact">c</a><a href="shop/about">会社概要</a><a href="/contact?x=1">お問い合わせ</a><footer>'), e("city"), F.lit("</footer></body></html>"),
    )
    return leads.select("lead_id", "url", "source_query", "store_name", "display_name", source.alias("html"))


L = "coalesce({c}, '')"
MAIN = ONE_SPACE.format(u="coalesce(display_name, '') || ' ' || coalesce(source_query, '') || ' ' || coalesce(phone, '')")


@query(rf"""
SELECT lead_id, CASE WHEN contains(email, '@') THEN split_part(email, '?', 1) ELSE 'shop' || lead_id || '@mail.example' END AS email,
  coalesce(nullif(regexp_extract(phone, '0[0-9]{{1,4}}-[0-9]{{1,4}}-[0-9]{{3,4}}'), ''), nullif(regexp_extract(phone, '0[0-9]{{9,10}}'), ''), nullif(regexp_extract(phone, '\+81[0-9-]{{10,}}'), ''), '') AS phone,
  {ONE_SPACE.format(u="coalesce(store_name, '')")}[1:200] AS title, {ONE_SPACE.format(u="coalesce(display_name, '')")}[1:200] AS h1, {MAIN} AS main, {ONE_SPACE.format(u="coalesce(city, '')")} AS footer,
  regexp_replace(trim(array_to_string([{ONE_SPACE.format(u="coalesce(store_name, '')")}[1:200], {ONE_SPACE.format(u="coalesce(display_name, '')")}[1:200], {MAIN}, {ONE_SPACE.format(u="coalesce(city, '')")}], ' ')), ' +', ' ', 'g') AS combined FROM leads
""")
def page_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Addresses, telephone numbers and text blocks of pages."""
    h = F.col("html")
    out = lead_pages(table(spark, d, "leads")).select("lead_id", page.first_email(h).alias("email"), page.first_phone(h).alias("phone"), page.blocks(h).alias("b"))
    return out.select("lead_id", "email", "phone", "b.title", "b.h1", "b.main", "b.footer", "b.combined")


@query(r"""
SELECT lead_id, list_filter(regexp_extract_all(lower(coalesce(email, '') || ' info@example.jp shop' || lead_id || '@mail.example'), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}'), lambda x: NOT ends_with(x, '.png')) AS emails FROM leads
""".replace("\\\\", "\\"))
def page_emails(spark: SparkSession, d: str) -> DataFrame:
    """All addresses of a page in order."""
    return lead_pages(table(spark, d, "leads")).select("lead_id", html.emails(F.col("html")).alias("emails"))


JP = page.JAPANESE
OWNER = "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{w}[^{JP}]{{0,5}}([{JP}]{{2,10}})', 1), '')" for w in page.OWNERS) + ", CASE WHEN len(bt) BETWEEN 1 AND 29 THEN bt END, '')"


@query(rf"""
WITH t AS (SELECT lead_id, '院長：' || coalesce(store_name, '') || ' ' || coalesce(source_query, '') AS t, coalesce(business_type, '') AS bt, coalesce(display_name, '') AS n FROM leads)
SELECT lead_id, {OWNER} AS owner, regexp_extract(n, '([{JP}・]{{1,30}}(?:{'|'.join(page.ENDINGS)}))', 1)[1:50] AS name FROM t
""")
def page_people(spark: SparkSession, d: str) -> DataFrame:
    """Owners named in pages, and names of businesses by their ending."""
    p = lead_pages(table(spark, d, "leads"))
    t = F.concat(F.lit("院長："), F.coalesce("store_name", F.lit("")), F.lit(" "), F.coalesce("source_query", F.lit("")))
    return p.select("lead_id", page.owner_name(t, F.col("html")).alias("owner"), page.japanese_name(F.coalesce("display_name", F.lit(""))).alias("name"))


AT = "position(p IN t)"


@query(rf"""
WITH t AS (SELECT page_id, coalesce(address, '') AS t, coalesce({', '.join(f"CASE WHEN contains(address, '{c}') THEN '{c}' END" for c in SITES)}) AS p FROM city_pages),
c AS (SELECT *, regexp_replace(regexp_extract(t, '〒?\s*[0-9]{{3}}-?[0-9]{{4}}\s*([^\n]{{10,50}})', 1), '^ +| +$', '', 'g') AS code FROM t)
SELECT page_id, CASE WHEN code <> '' THEN code[1:100] WHEN p IS NOT NULL THEN {ONE_SPACE.format(u=f"substr(t, greatest(1, {AT} - 20), least({AT} - 1, 20) + 80)")}[1:100] ELSE '' END AS address FROM c
""")
def page_addresses(spark: SparkSession, d: str) -> DataFrame:
    """What follows a postal code, else the surroundings of a listed place."""
    return table(spark, d, "city_pages").select("page_id", page.address_window(F.coalesce("address", F.lit("")), SITES).alias("address"))


@query(rf"""
WITH t AS (SELECT lead_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || '://' || {NET.format(u='url')} AS root, regexp_replace({PATH.format(u='url')}, '[^/]*$', '') AS folder FROM leads)
SELECT lead_id, CASE WHEN {NET.format(u='url')} <> '' THEN root || '/contact?x=1' END AS contact, CASE WHEN {NET.format(u='url')} <> '' THEN root || CASE WHEN folder = '' THEN '/' ELSE folder END || 'shop/about' END AS about FROM t
""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """The first links to a contact page and to an about page on the same host."""
    h, u = F.col("html"), F.col("url")
    return lead_pages(table(spark, d, "leads")).select("lead_id", page.first_link(h, u, ["contact", "お問い合わせ"]).alias("contact"), page.first_link(h, u, ["会社概要", "about"]).alias("about"))


HOST = "regexp_replace(regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', '')"


@query(rf"""
WITH c AS (SELECT contact_url, arg_min(contact_fetch_status, page_id) AS status, arg_min(coalesce(contact_page_has_form, false), page_id) AS form, arg_min(coalesce(contact_page_address, ''), page_id) AS address FROM city_pages WHERE contact_url <> '' GROUP BY contact_url),
p AS (SELECT page_id, CASE WHEN contact_url <> '' AND {HOST.format(u='contact_url')} <> '' AND {HOST.format(u='contact_url')} = {HOST.format(u='url')} THEN contact_url END AS link FROM city_pages)
SELECT page_id, link AS contact_link, CASE WHEN link IS NULL THEN 'none' ELSE coalesce(status, 'not_fetched') END AS contact_status, coalesce(form, false) AS contact_form,
  CASE WHEN c.contact_url IS NULL THEN '' ELSE {ONE_SPACE.format(u="address")} END AS contact_text, false AS line_link FROM p LEFT JOIN c ON p.link = c.contact_url
""")
def contact_pages(spark: SparkSession, d: str) -> DataFrame:
    """What the contact page of each page shows, joined by the link that the page gives."""
    t = table(spark, d, "city_pages")
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    pages = t.select("page_id", "url", F.concat(F.lit('<body><a href="'), e("contact_url"), F.lit('">お問い合わせ</a></body>')).alias("html"))
    pages = pages.join(t.where("coalesce(contact_url, '') = ''").select("page_id", F.lit("<body>x</body>").alias("bare")), "page_id", "left").withColumn("html", F.coalesce("bare", "html")).drop("bare")
    form = F.when(F.coalesce("contact_page_has_form", F.lit(False)), "<form></form>").otherwise("")
    side = t.where("contact_url <> ''").groupBy(F.col("contact_url").alias("url")).agg(F.min_by("contact_fetch_status", "page_id").alias("status"), F.min_by(F.concat(form, e("contact_page_address")), "page_id").alias("html"))
    return page.contact_evidence(pages, side)


BIG = ["3000000000", "-5", " 42 ", "4.5", "x", "", "+7", "99999999999999999999999999999999999999999", "-99999999999999999999999999999999999999999", "007"]


@query(rf"""
WITH i AS (SELECT * FROM (VALUES {', '.join(f"({-n - 1}, '{v}')" for n, v in enumerate(BIG))}) AS v(n, s) UNION ALL SELECT lead_id, CAST(lead_score AS VARCHAR) FROM leads),
d AS (SELECT n, CASE WHEN regexp_matches(s, '^\s*[+-]?[0-9]+\s*$') THEN trim(s) END AS w FROM i)
SELECT n, CAST(CASE WHEN w IS NULL OR starts_with(w, '-') THEN 0 WHEN len(regexp_replace(w, '^[+]?0*', '')) > 3 THEN 100 ELSE least(100, coalesce(try_cast(w AS INTEGER), 0)) END AS INTEGER) AS score FROM d
""")
def score_texts(spark: SparkSession, d: str) -> DataFrame:
    """Scores of texts: clamped, whatever their length."""
    made = spark.createDataFrame([(-n - 1, v) for n, v in enumerate(BIG)], "n bigint, s string")
    every = made.unionByName(table(spark, d, "leads").select(F.col("lead_id").alias("n"), F.col("lead_score").cast("string").alias("s")))
    return every.select("n", text.score_0_100(F.col("s")).alias("score"))


WIDE = ["店舗　名", "【人気】サロン花｜", "　 a　　b ／", "[x]", "﻿花​店 - ", "｜", ""]
ENDS = r"[ \-–—|｜:：／/\[\]【】]+"


@query(rf"""
WITH i AS (SELECT * FROM (VALUES {', '.join(f"({-n - 1}, '{v}')" for n, v in enumerate(WIDE))}) AS v(n, s) UNION ALL SELECT name_id, original_title FROM site_names)
SELECT n, regexp_replace(regexp_replace(regexp_replace(coalesce(s, ''), '[\x{{FEFF}}\x{{200B}}]', '', 'g'), '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+', ' ', 'g'), '^{ENDS}|{ENDS}$', '', 'g') AS name FROM i
""")
def clean_names(spark: SparkSession, d: str) -> DataFrame:
    """Names without separators and brackets at their ends, wide spaces made narrow."""
    made = spark.createDataFrame([(-n - 1, v) for n, v in enumerate(WIDE)], "n bigint, s string")
    every = made.unionByName(table(spark, d, "site_names").select(F.col("name_id").alias("n"), F.col("original_title").alias("s")))
    return every.select("n", text.clean_spaces(F.col("s")).alias("name"))


PREFERRED = ["salon", "peraichi.com", "/shop"]


@query(rf"""
WITH t AS (SELECT lead_id, url, lower(url) AS u, lower({TRIM.format(u='domain')}) AS v, {NET.format(u='url')} AS net, {PATH.format(u='url')} AS p FROM leads),
c AS (SELECT *, {CLEAN.format(v="CASE WHEN contains(v, '://') THEN regexp_extract(v, '://([^/?#]*)', 1) ELSE v END")} AS c, replace(lower(net), 'www.', '') AS dom FROM t)
SELECT lead_id, CASE WHEN contains(c, '.') AND regexp_matches(c, '^[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?)+$') THEN c ELSE '' END AS strict,
  CASE WHEN {' OR '.join(f"contains(u, '{p}')" for p in PREFERRED)} THEN 100 WHEN net <> '' AND NOT (contains(u, '.blogspot.') OR contains(u, '.wordpress.com') OR contains(u, '.tumblr.')) AND len(p) - len(replace(p, '/', '')) <= 2 THEN 50 ELSE 10 END AS url_score,
  coalesce(starts_with(dom, 'jp.') OR contains(dom, '.jp.') OR contains(dom, 'japan') OR {' OR '.join(f"contains(u, '{s}')" for s in ['japan', 'tokyo', 'osaka', 'kyoto', 'nagoya', 'yokohama', 'sapporo', 'fukuoka', 'sendai', 'hiroshima', 'kobe', '/jp/', '/ja/', '-jp', '_jp'])} OR regexp_matches(lower(p) || '?' || lower(regexp_extract(url, '^[^?#]*\?([^#]*)', 1)), '%e[3-9]'), false) AS national,
  coalesce({HOST.format(u='url')} <> '' AND {HOST.format(u='url')} = {HOST.format(u=chr(39)+'https://'+chr(39)+' || v || '+chr(39)+'/x'+chr(39))}, false) AS same_host FROM c
""")
def url_extras(spark: SparkSession, d: str) -> DataFrame:
    """Strict domains, the coarse score of an address, national signals, equal hosts."""
    u = F.col("url")
    strict = F.when(F.col("domain").isNotNull(), urls.strict_domain(F.col("domain"))).otherwise("")
    other = F.concat(F.lit("https://"), F.lower(urls.strip(F.col("domain"))), F.lit("/x"))
    return table(spark, d, "leads").select("lead_id", strict.alias("strict"), F.coalesce(urls.url_score(u, PREFERRED), F.lit(10)).alias("url_score"), urls.national_signal(u).alias("national"), urls.same_host(u, other).alias("same_host"))


@query(r"""
WITH t AS (SELECT lead_id, fetched_at_iso AS ts FROM leads)
SELECT lead_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS local, strftime(ts + INTERVAL 9 HOUR, '%Y%m%d_%H%M%S') AS run FROM t
""")
def run_ids(spark: SparkSession, d: str) -> DataFrame:
    """Local time and run identifier of an instant."""
    local, run = text.run_times(F.col("fetched_at_iso"))
    return table(spark, d, "leads").select("lead_id", local.alias("local"), run.alias("run"))


SLUG = r"regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}_]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(rf"""
WITH t AS (SELECT page_id, regexp_replace(coalesce({TRIM.format(u='url')}, ''), '', '') AS website, coalesce({TRIM.format(u='contact_url')}, '') AS contact, coalesce({ONE_SPACE.format(u='display_name')}, '') AS one, coalesce(regexp_replace(display_name, '^[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+|[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+$', '', 'g'), '') AS nm, coalesce({TRIM.format(u='domain')}, '') AS d0, coalesce({TRIM.format(u='area_guess')}, '') AS area FROM city_pages),
c AS (SELECT *, {CLEAN.format(v="lower(d0)")} AS cd, {CLEAN.format(v="lower(regexp_extract(website, '://([^/?#]*)', 1))")} AS cw, {CLEAN.format(v="lower(regexp_extract(contact, '://([^/?#]*)', 1))")} AS cc FROM t),
k AS (SELECT *, CASE WHEN contains(cd, '.') THEN cd WHEN contains(cw, '.') THEN cw WHEN contains(cc, '.') THEN cc ELSE '' END AS dom FROM c),
b AS (SELECT *, CASE WHEN nm <> '' THEN nm ELSE dom END AS business_name, '-r' || lpad(CAST(page_id AS VARCHAR), greatest(5, len(CAST(page_id AS VARCHAR)))::INTEGER, '0') AS num FROM k)
SELECT CASE WHEN dom <> '' THEN 'lf-' || regexp_replace({SLUG.format(x="replace(dom, '.', '-')")}[1:56], '-+$', '') WHEN {SLUG.format(x="business_name")} <> '' THEN 'lf-' || regexp_replace({SLUG.format(x="business_name")}[1:40], '-+$', '') || num ELSE 'lf-unknown' || num END AS lead_id,
  business_name, dom AS domain, website, contact AS contact_url, area, 'city_pages' AS source_csv, CAST(page_id AS VARCHAR) AS source_row, CAST(page_id AS VARCHAR) AS original__page_id, area AS original__area_guess FROM b
""")
def handoff_rows(spark: SparkSession, d: str) -> DataFrame:
    """Pages as hand-off rows: lasting columns, generated identifiers, original columns."""
    t = table(spark, d, "city_pages").select("page_id", "domain", F.col("url").alias("website"), "contact_url", "display_name", "area_guess")
    aliases = {"lead_id": ["lead_id", "id", "管理番号"], "domain": ["domain"], "website": ["website", "URL"], "contact_url": ["contact_url", "contact_page"], "business_name": ["business_name", "display_name"], "area": ["area", "area_guess"]}
    return flows.handoff(t, aliases, F.col("page_id"), "city_pages").drop("original__domain", "original__website", "original__contact_url", "original__display_name")


CHECKS = "SELECT url, max(http_status) AS http_status, min(url) AS final_url FROM leads WHERE url IS NOT NULL GROUP BY url"
ALIVE = "coalesce(NOT (c.http_status IN (404, 410) OR c.http_status >= 500), false)"
KEYED = r"regexp_replace(lower(regexp_extract(CASE WHEN regexp_matches(c.final_url, '^https?://') THEN c.final_url ELSE 'https://' || c.final_url END, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"


def checked(leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leads and one check for each of their addresses, whose final address is its own."""
    own = leads.select(F.col("lead_id").alias("seq"), "run_id", "url", F.coalesce("lead_score", F.lit(0)).alias("score"))
    return own, leads.where("url is not null").groupBy("url").agg(F.max("http_status").alias("status")).withColumn("final_url", F.col("url"))


@query(f"""
WITH c AS ({CHECKS}), j AS (SELECT lead_id, run_id, coalesce(lead_score, 0) AS s, {KEYED} AS dom FROM leads l JOIN c ON l.url = c.url WHERE {ALIVE})
SELECT lead_id, run_id, 'OK' AS status FROM (SELECT *, row_number() OVER (PARTITION BY run_id, dom ORDER BY s DESC, lead_id) AS n FROM j WHERE dom <> '') WHERE n = 1
""")
def validated_leads(spark: SparkSession, d: str) -> DataFrame:
    """Live leads, the best of each domain of the final address in each run."""
    own, checks = checked(table(spark, d, "leads"))
    return flows.validated(own, checks, "run_id").select(F.col("seq").alias("lead_id"), "run_id", "status")


@query(f"""
WITH c AS ({CHECKS}), j AS (SELECT l.run_id, {ALIVE} AS alive, {KEYED} AS dom FROM leads l LEFT JOIN c ON l.url = c.url),
t AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE alive) AS alive, count(*) FILTER (WHERE NOT alive) AS dead, count(DISTINCT dom) FILTER (WHERE alive AND dom <> '') AS unique FROM j GROUP BY run_id)
SELECT run_id, total, alive, dead, "unique" FROM t UNION ALL SELECT NULL, sum(total)::BIGINT, sum(alive)::BIGINT, sum(dead)::BIGINT, sum("unique")::BIGINT FROM t
""")
def validation_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the validation for each run and for all."""
    return flows.validation_totals(*checked(table(spark, d, "leads")), "run_id")


@query("""
WITH e AS (SELECT url, max(CAST(lead_id + 5000 AS VARCHAR)) AS id FROM (SELECT url, lead_id FROM leads WHERE url_status = 'BLOCKED' AND url IS NOT NULL AND trim(url) <> '') GROUP BY url), m AS (SELECT max(lead_id + 5000) AS top FROM leads WHERE url_status = 'BLOCKED' AND url IS NOT NULL AND trim(url) <> ''),
c AS (SELECT lead_id, url, lead_score, min(lead_id) OVER (PARTITION BY url) AS pos, row_number() OVER (PARTITION BY url ORDER BY lead_score DESC, lead_id) AS n FROM leads WHERE lead_score >= 40 AND trim(url) <> ''),
b AS (SELECT c.*, e.id AS old FROM c LEFT JOIN e ON c.url = e.url WHERE n = 1)
SELECT url, lead_score AS score, CASE WHEN old IS NOT NULL THEN lpad(old, CAST(greatest(5, len(old)) AS INTEGER), '0') ELSE CAST(m.top + row_number() OVER (PARTITION BY old IS NULL ORDER BY lead_score DESC, pos) AS VARCHAR) END AS id FROM b, m
""")
def carried_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers carried over by address, new ones after the largest."""
    leads = table(spark, d, "leads")
    collected = leads.select(F.col("lead_id").alias("seq"), "url", F.col("lead_score").alias("score"))
    existing = leads.where("url_status = 'BLOCKED' and trim(url) <> ''").select((F.col("lead_id") + 5000).cast("string").alias("id"), "url")
    return flows.carried_ids(collected, existing).select("url", "score", "id")


@query(rf"""
WITH l AS (SELECT user_id AS lead_id, arg_max(CASE event_type WHEN 'purchase' THEN 'sent' WHEN 'error' THEN 'fetch error' WHEN 'click' THEN 'skipped_dup' ELSE 'prepared' END, event_id) AS s FROM events GROUP BY 1),
j AS (SELECT c_custkey AS lead_id, coalesce(nullif(l.s, ''), CASE WHEN c_acctbal < 0 THEN 'failed' ELSE '' END) AS s, CASE WHEN c_nationkey = 3 THEN 'Exception: x' ELSE '' END AS r, l.lead_id IS NOT NULL AS held FROM customer LEFT JOIN l ON c_custkey = l.lead_id),
k AS (SELECT *, CASE WHEN s = 'sent' THEN 'sent' WHEN starts_with(s, 'prepared') THEN 'prepared' WHEN starts_with(s, 'skipped') THEN 'skipped' WHEN s = 'failed' OR contains(s, 'error') OR starts_with(lower(r), 'exception') THEN 'failed' ELSE 'unknown' END AS o FROM j)
SELECT 'r1' AS run_id, lead_id, o AS outcome, CASE WHEN o = 'sent' THEN 'sent' ELSE '' END AS sent_status, CASE WHEN o = 'skipped' THEN coalesce(nullif(r, ''), s) ELSE '' END AS skip_reason, CASE WHEN o = 'failed' THEN coalesce(nullif(r, ''), s) ELSE '' END AS error_reason,
  CASE WHEN held THEN 'ledger' WHEN s <> '' OR r <> '' THEN 'handoff_status' ELSE 'unknown' END AS outcome_source FROM k
""")
def lead_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of leads by the latest entry of a ledger."""
    leads = table(spark, d, "customer").select(F.col("c_custkey").alias("lead_id"), F.when(F.col("c_acctbal") < 0, "failed").otherwise("").alias("status"), F.when(F.col("c_nationkey") == 3, "Exception: x").otherwise("").alias("reason"))
    kind = F.when(F.col("event_type") == "purchase", "sent").when(F.col("event_type") == "error", "fetch error").when(F.col("event_type") == "click", "skipped_dup").otherwise("prepared")
    ledger = table(spark, d, "events").select(F.col("user_id").alias("lead_id"), kind.alias("status"), F.lit("").alias("reason"), F.col("event_id").alias("seq"))
    return flows.outcomes(leads, ledger, "r1")


NOISE = "coalesce(ends_with(lower(trim(domain)), '.example') AND starts_with(regexp_replace(lower(trim(domain)), '^www\\.', ''), 'portal'), false)"


@query(f"""
WITH t AS (SELECT run_id, coalesce(url_status, '') <> 'BLOCKED' AS kept, {NOISE} AS noise, coalesce(lead_score, 0) > 0 AS pos, coalesce(nullif(solo_classification, ''), 'unknown') AS cls FROM leads),
c AS (SELECT run_id, count(*) AS bt, count(*) FILTER (WHERE noise) AS bn, count(*) FILTER (WHERE kept) AS atot, count(*) FILTER (WHERE kept AND noise) AS an, count(*) FILTER (WHERE pos AND NOT noise) AS bp, count(*) FILTER (WHERE pos AND NOT noise AND cls NOT IN ('solo', 'small', 'corporate')) AS bu,
  count(*) FILTER (WHERE kept AND pos AND NOT noise) AS ap, count(*) FILTER (WHERE kept AND pos AND NOT noise AND cls NOT IN ('solo', 'small', 'corporate')) AS au FROM t GROUP BY run_id),
r AS (SELECT run_id, CASE WHEN bt > 0 THEN round_even(bn / bt, 6) ELSE 0.0 END AS bm, CASE WHEN atot > 0 THEN round_even(an / atot, 6) ELSE 0.0 END AS am, CASE WHEN ap > 0 THEN round_even(au / ap, 6) ELSE 0.0 END AS u FROM c)
SELECT run_id, am <= bm AS bad_mix, u <= 0.2 AS unknown_rate, am <= bm AND u <= 0.2 AS passed, list_filter([CASE WHEN NOT am <= bm THEN 'bad_mix' END, CASE WHEN NOT u <= 0.2 THEN 'unknown_rate' END], lambda x: x IS NOT NULL) AS failed FROM r
""")
def run_gates(spark: SparkSession, d: str) -> DataFrame:
    """Gates of a change over every run as an input of its own."""
    leads = table(spark, d, "leads")
    flags = kpi_flags(leads).select("lead_id", "noise", "pos", "cls").join(leads.select("lead_id", "run_id", "url_status"), "lead_id")
    counts = {"total": F.lit(True), "noise": F.col("noise"), "positive": F.col("pos"), "unknown": F.col("pos") & ~F.col("cls").isin("solo", "small", "corporate")}
    rates = {n: RATES[n] for n in ("bad_domain_mix", "unknown_rate")}
    checks = {"bad_mix": F.col("a_bad_domain_mix") <= F.col("b_bad_domain_mix"), "unknown_rate": F.col("a_unknown_rate") <= 0.2}
    return flows.validation_gates(flags, "run_id", F.coalesce("url_status", F.lit("")) != "BLOCKED", counts, rates, checks).select("run_id", "bad_mix", "unknown_rate", "passed", "failed")


@query("""
WITH l AS (SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS loop, value AS after, 10.0 AS before, event_type = 'purchase' AS improved, event_type <> 'error' AS passed FROM events),
a AS (SELECT run, bool_or(passed) AS p FROM l GROUP BY run),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN improved THEN 0 WHEN passed THEN 1 ELSE 2 END, CASE WHEN improved THEN -after END, CASE WHEN improved OR passed THEN loop ELSE -loop END) AS n FROM l) WHERE n = 1),
o AS (SELECT c.run, loop, after - before AS delta, a.p AS passed, list_filter([CASE WHEN NOT a.p THEN 'gate_failed' END, CASE WHEN after - before < 0 THEN 'theta_degraded' END, CASE WHEN NOT improved THEN 'theta_not_improved' END], lambda x: x IS NOT NULL) AS regressions FROM c JOIN a ON c.run = a.run)
SELECT run, loop, delta, passed, regressions, row_number() OVER (ORDER BY delta, run) <= 3 AS worst FROM o
""")
def run_convergence(spark: SparkSession, d: str) -> DataFrame:
    """The loop that counts of each run, its regressions, and the three worst runs."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    loops = table(spark, d, "events").select(F.col("user_id").alias("run"), F.row_number().over(w).alias("loop"), F.col("value").alias("after"), F.lit(10.0).alias("before"), (F.col("event_type") == "purchase").alias("improved"), (F.col("event_type") != "error").alias("passed"))
    return flows.convergence(loops)


@query("""
WITH t AS (SELECT name_id, coalesce(website, '') AS url, CASE WHEN name_score < 40 THEN 'DROP' ELSE 'KEEP' END AS action, CASE name_source WHEN 'title' THEN 'JOB' ELSE 'NO_LOCAL_SIGNAL' END AS flag, coalesce(name_score, 0) AS s FROM site_names),
r AS (SELECT url, min('answer: {"action":"' || action || '","category":"c","flags":["' || flag || '"],"confidence":' || s || '} end') AS a FROM t WHERE url <> '' GROUP BY url),
v AS (SELECT name_id, regexp_extract(a, '"action":"([A-Z]*)"', 1) AS action, regexp_extract(a, '"flags":\\["([A-Z_]*)"', 1) AS flag, CAST(nullif(regexp_extract(a, '"confidence":(-?[0-9]+)', 1), '') AS INTEGER) AS c, a FROM t LEFT JOIN r ON t.url = r.url)
SELECT name_id, CASE WHEN action = 'DROP' AND c >= 20 AND flag IN ('PORTAL', 'CORPORATE', 'FOREIGN', 'JOB') THEN 'DROP' ELSE 'KEEP' END AS action, CASE WHEN a IS NULL THEN 'none' ELSE 'c' END AS category, CASE WHEN a IS NULL THEN CAST([] AS VARCHAR[]) ELSE [flag] END AS flags, coalesce(c, 0) AS confidence FROM v
""")
def model_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts out of a table of raw answers of a model, kept unless a hard flag says otherwise."""
    return flows.model_verdicts(*answered(spark, d), least=20).select("name_id", "action", "category", "flags", "confidence")


def answered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "site_names").select("name_id", F.coalesce("website", F.lit("")).alias("url"), "name_score", "name_source")
    answer = F.concat(F.lit('answer: {"action":"'), F.when(F.col("name_score") < 40, "DROP").otherwise("KEEP"), F.lit('","category":"c","flags":["'), F.when(F.col("name_source") == "title", "JOB").otherwise("NO_LOCAL_SIGNAL"), F.lit('"],"confidence":'), F.coalesce("name_score", F.lit(0)).cast("string"), F.lit("} end"))
    return t.select("name_id", "url"), t.where("url <> ''").select("url", answer.alias("answer"))


@query("""
WITH k AS (SELECT CASE domain WHEN 'x' THEN 'x' ELSE domain END AS value FROM city_pages WHERE domain IS NOT NULL) SELECT 'domain' AS kind, value, count(*) AS n, 50.0 AS confidence FROM k GROUP BY value
UNION ALL SELECT 'action', 'KEEP', count(*), 50.0 FROM city_pages UNION ALL SELECT 'category', coalesce(category_guess, 'none'), count(*), 50.0 FROM city_pages GROUP BY 2
""".replace("SELECT 'domain' AS kind", "SELECT 'flag' AS kind"))
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of verdicts by action, category and flag."""
    v = table(spark, d, "city_pages").select(F.lit("KEEP").alias("action"), F.coalesce("category_guess", F.lit("none")).alias("category"), F.array_compact(F.array("domain")).alias("flags"), F.lit(50).alias("confidence"))
    return flows.verdict_counts(v)


@query(rf"""
WITH k AS (SELECT batch_id, url_sheet AS key, coalesce({TRIM.format(u='l.url')}, '') <> '' AS has FROM lead_lines l JOIN ({SHEET}) s ON l.line_id = s.line_id)
SELECT count(DISTINCT key) AS added FROM k WHERE has AND batch_id % 2 = 1 AND key NOT IN (SELECT key FROM k WHERE has AND batch_id % 2 = 0)
""")
def appended_addresses(spark: SparkSession, d: str) -> DataFrame:
    """How many addresses an append adds to a table that holds every other batch."""
    lines = table(spark, d, "lead_lines").where(urls.strip(F.coalesce("url", F.lit(""))) != "").select("batch_id", "url")
    return sinks.new_rows(lines.where("batch_id % 2 = 1"), lines.where("batch_id % 2 = 0")).agg(F.count("*").alias("added"))


@query("""
WITH n AS (SELECT name_id, display_name AS nm, name_confidence AS c FROM site_names) SELECT name_id, CASE WHEN coalesce(nm, '') <> '' THEN nm ELSE '' END AS salon_name, nm AS display_name, coalesce(c = 'low', false) AS needs_review FROM n
""")
def written_names(spark: SparkSession, d: str) -> DataFrame:
    """Names written to all columns that hold them, and rows to review."""
    t = table(spark, d, "site_names").select("name_id", "display_name", "name_confidence")
    return flows.written_names(t, F.col("display_name"), ["display_name", "salon_name"], F.col("name_confidence") == "low").select("name_id", "salon_name", "display_name", "needs_review")


@query("""
WITH f AS (SELECT count(*) AS leads, count(*) FILTER (WHERE url_status = 'OK') AS ok FROM leads), t AS (SELECT domain, count(*) AS n FROM leads WHERE domain IS NOT NULL GROUP BY domain ORDER BY n DESC, domain LIMIT 3)
SELECT leads, ok, (SELECT count(DISTINCT source_query) FROM leads) AS n_queries, (SELECT list(domain ORDER BY n DESC, domain) FROM t) AS top_domains FROM f
""")
def run_meta(spark: SparkSession, d: str) -> DataFrame:
    """Counts, number of queries and most frequent domains of a collection."""
    counted = {"leads": F.lit(True), "ok": F.col("url_status") == "OK"}
    return sinks.run_meta(table(spark, d, "leads"), counted, query="source_query", most=3).drop("query_hash")


@query("""SELECT lead_id, url FROM leads ORDER BY lead_id LIMIT 200""")
def first_slice(spark: SparkSession, d: str) -> DataFrame:
    """The first rows in order, which is the feature: a fixed slice for trials."""
    return table(spark, d, "leads").select("lead_id", "url").orderBy("lead_id").limit(200)


@query("""
WITH t AS (SELECT lead_id, CASE WHEN contains(lower(coalesce(url, '') || ' ' || coalesce(source_query, '')), 'salon') THEN 'salon' WHEN contains(lower(coalesce(url, '') || ' ' || coalesce(source_query, '')), 'yoga') THEN 'yoga' ELSE 'custom' END AS platform, url, solo_score, lead_score FROM leads)
SELECT platform, count(*) AS n, count(*) FILTER (WHERE coalesce(solo_score, 0) >= 5) AS solo FROM t GROUP BY platform
""")
def platform_counts(spark: SparkSession, d: str) -> DataFrame:
    """Leads by platform, the first in order whose pattern stands in the address or the query."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = classify.platform(e("url"), e("source_query"), {"salon": ["salon"], "yoga": ["yoga"]})
    return aggregate.conditional_counts(table(spark, d, "leads").withColumn("platform", kind), {"n": F.lit(True), "solo": F.coalesce("solo_score", F.lit(0)) >= 5}, ["platform"])


@query(r"""
WITH s AS (SELECT DISTINCT domain AS dom FROM site_names WHERE name_confidence = 'high' AND domain IS NOT NULL), t AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS h FROM city_pages WHERE url IS NOT NULL)
SELECT page_id, arg_max(dom, len(dom)) AS listed FROM t JOIN s ON h = dom OR ends_with(h, '.' || dom) GROUP BY page_id
""")
def listed_domains(spark: SparkSession, d: str) -> DataFrame:
    """The longest listed domain above each page."""
    listed = table(spark, d, "site_names").where("name_confidence = 'high' and domain is not null").select(F.col("domain").alias("dom"))
    return joins.marked_by_suffix(table(spark, d, "city_pages").where("url is not null"), "page_id", urls.domain_key(F.col("url")), listed, "dom")


@query("""
WITH p AS (SELECT DISTINCT city, business_type FROM leads WHERE city IS NOT NULL AND business_type IS NOT NULL), f AS (SELECT city, business_type, url, min(CASE url_status WHEN 'OK' THEN 1 WHEN 'BLOCKED' THEN 2 ELSE 3 END) AS first FROM leads WHERE url_status <> 'OK' OR lead_score > 60 GROUP BY 1, 2, 3),
n AS (SELECT city, business_type, count(*) FILTER (WHERE first < 2) AS b2, count(*) FILTER (WHERE first < 3) AS b3 FROM f GROUP BY 1, 2),
d AS (SELECT p.city, p.business_type, 1 AS pass, 15 AS n_queries FROM p UNION ALL SELECT p.city, p.business_type, 2, 10 FROM p LEFT JOIN n ON p.city = n.city AND p.business_type = n.business_type WHERE coalesce(b2, 0) < 2 UNION ALL SELECT p.city, p.business_type, 3, 6 FROM p LEFT JOIN n ON p.city = n.city AND p.business_type = n.business_type WHERE coalesce(b3, 0) < 2),
o AS (SELECT *, sum(n_queries) OVER (ORDER BY pass, city, business_type) AS upto FROM d)
SELECT city, business_type, pass, n_queries FROM o WHERE upto <= 9000
""")
def query_passes(spark: SparkSession, d: str) -> DataFrame:
    """Passes that are still due for each pair, within a budget of queries."""
    from ..operators.generate import passes

    leads = table(spark, d, "leads")
    pairs = leads.where("city is not null and business_type is not null").select("city", "business_type").distinct()
    hits = leads.where("url_status <> 'OK' or lead_score > 60").select("city", "business_type", "url", F.when(F.col("url_status") == "OK", 1).when(F.col("url_status") == "BLOCKED", 2).otherwise(3).alias("pass"))
    return passes(pairs, hits, ["city", "business_type"], 2, [15, 10, 6], most=9000)


REGION = KEYED.replace("c.final_url", "l.url")


@query(rf"""
WITH c AS (SELECT url, max(http_status) AS http_status FROM leads WHERE url IS NOT NULL GROUP BY url),
j AS (SELECT l.lead_id, coalesce(l.lead_score, 0) AS s, coalesce(l.sales_label, '') AS label, {REGION} AS dom FROM leads l JOIN c ON l.url = c.url WHERE {ALIVE}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dom ORDER BY s DESC, lead_id) AS n FROM j WHERE dom <> '') WHERE n = 1)
SELECT lead_id, dom AS domain, row_number() OVER (ORDER BY CASE label WHEN '○' THEN 2 WHEN '△' THEN 1 ELSE 0 END DESC, s DESC, lead_id) AS position FROM b
""")
def region_leads(spark: SparkSession, d: str) -> DataFrame:
    """A region's run from collected leads to its list: liveness by address, live ones, the best of each domain, presentation order."""
    return flows.region_run(*checked(table(spark, d, "leads")), table(spark, d, "leads").select(F.col("lead_id").alias("seq"), F.coalesce("sales_label", F.lit("")).alias("label"))).select(F.col("seq").alias("lead_id"), "domain", "position")


KINDS = ["サロン", "ヨガ", "Nail"]


@query(f"""
WITH t AS (SELECT lead_id, repeat(coalesce(display_name, '') || ' ', 6) AS t, coalesce(store_name, '') || CAST(lead_id % 7 AS VARCHAR) || CASE WHEN lead_id % 5 = 0 THEN '選' ELSE '' END AS title FROM leads)
SELECT lead_id, regexp_matches(title, '[0-9]{{1,3}}選') OR ({' + '.join(f"CASE WHEN (len(t) - len(replace(t, '{w}', ''))) / {len(w)} > 5 THEN 1 ELSE 0 END" for w in KINDS)}) >= 1 AS listing, '10:00〜' || CAST(lead_id % 12 AS VARCHAR) || ':30' AS hours FROM t
""")
def page_listings(spark: SparkSession, d: str) -> DataFrame:
    """Pages that list many businesses, and opening hours after their label."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    i = F.col("lead_id")
    body, title = F.repeat(F.concat(e("display_name"), F.lit(" ")), 6), F.concat(e("store_name"), (i % 7).cast("string"), F.when(i % 5 == 0, "選").otherwise(""))
    open_at = F.concat(F.lit("x 1:00-2:00 営業時間： 毎日 10:00〜"), (i % 12).cast("string"), F.lit(":30 まで"))
    return table(spark, d, "leads").select("lead_id", html.listing_signals(body, title, KINDS, kinds=1).alias("listing"), html.hours(open_at).alias("hours"))


@query(r"""SELECT page_id, CASE WHEN display_name IS NULL THEN CAST([] AS VARCHAR[]) ELSE [regexp_replace(display_name, '^[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+$', '', 'g')] END AS names FROM city_pages""")
def page_jsonld(spark: SparkSession, d: str) -> DataFrame:
    """Names of businesses in the JSON-LD of pages."""
    doc = F.to_json(F.struct(F.array(F.struct(F.lit("LocalBusiness").alias("@type"), F.col("display_name").alias("name")), F.struct(F.lit("WebSite").alias("@type"), F.lit("x").alias("name"))).alias("@graph")))
    pages = table(spark, d, "city_pages").select("page_id", "url", F.concat(F.lit('<script type="application/ld+json">'), doc, F.lit("</script><script type=\"application/ld+json\">{broken</script>")).alias("html"))
    return html.read_pages(pages, "page_id").select("page_id", "names")


@query(r"""
WITH f AS (SELECT lead_id, domain, lead_score, url_status FROM leads WHERE url_status = 'OK')
SELECT lead_id, domain, row_number() OVER (ORDER BY domain NULLS FIRST, lead_score DESC NULLS LAST, lead_id) AS position FROM f
""")
def domain_order(spark: SparkSession, d: str) -> DataFrame:
    """Global positions by domain, falling score and identifier."""
    from ..operators.rank import positions

    leads = table(spark, d, "leads").where("url_status = 'OK'").select("lead_id", "domain", "lead_score")
    return positions(leads, [F.col("domain").asc_nulls_first(), F.col("lead_score").desc_nulls_last(), F.col("lead_id")]).select("lead_id", "domain", "position")


@query(r"""
SELECT page_id, coalesce(nullif(display_name, ''), nullif(title, ''), '') || chr(10) || coalesce(url, '') || chr(10) || '△ ' || coalesce(category_guess, '') AS text,
  list_distinct(list_filter([domain, domain], lambda x: x IS NOT NULL)) AS once FROM city_pages
""")
def three_lines(spark: SparkSession, d: str) -> DataFrame:
    """Leads as three lines of text; elements once, in their first order."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    name = F.coalesce(filled("display_name"), filled("title"), F.lit(""))
    return table(spark, d, "city_pages").select("page_id", sinks.three_lines(name, F.col("url"), F.col("category_guess")).alias("text"), F.array_distinct(F.array_compact(F.array("domain", "domain"))).alias("once"))
