"""Queries of the URL, domain and text functions over leads, pages, names and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..operators import classify, filters
from ..session import table
from .registry import query

NET = r"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
PATH = r"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
QS = r"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"
TRIM = r"regexp_replace({u}, '^[\s\x{{3000}}]+|[\s\x{{3000}}]+$', '', 'g')"


ONE_SPACE = r"trim(regexp_replace({u}, '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w + "'" for w in words)


def any_of(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


def suffix_of(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"({expr} = '{w}' OR ends_with({expr}, '.{w}'))" for w in words) + ")"


U = TRIM.format(u="url")
HTTPS = rf"CASE WHEN regexp_matches({U}, '^https?://') THEN {U} ELSE 'https://' || {U} END"


@query(rf"""
WITH t AS (SELECT line_id, url, {HTTPS} AS u FROM lead_lines),
s AS (SELECT line_id, url, regexp_replace(lower({NET.format(u='u')}), '^www\.', '') AS h, {PATH.format(u='u')} AS p,
  array_to_string(list_filter(string_split({QS.format(u='u')}, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({quoted(rules.TRACKING_PARAMS)})), '&') AS q FROM t)
SELECT line_id, CASE WHEN coalesce(url, '') = '' THEN '' ELSE 'https://' || h || CASE WHEN p = '/' OR regexp_replace(p, '/+$', '') = '' THEN '/' ELSE regexp_replace(p, '/+$', '') END
  || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS url_strict FROM s
""")
def url_strict(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lead_lines").select("line_id", urls.normalize_strict(F.col("url")).alias("url_strict"))


@query(rf"""
SELECT line_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower({NET.format(u='url')}), '^www\.', '') || regexp_replace({PATH.format(u='url')}, '/+$', '') AS url_key,
  CASE WHEN len(split_part(url, '#', 1)) - len(replace(split_part(url, '#', 1), '/', '')) > 3 THEN regexp_replace(split_part(url, '#', 1), '/+$', '') ELSE split_part(url, '#', 1) END AS url_web,
  lower(regexp_replace({NET.format(u='url')} || {PATH.format(u='url')}, '/+$', '')) AS url_legacy FROM lead_lines
""")
def url_variants(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "lead_lines").select(
        "line_id", urls.normalize_key(u).alias("url_key"), urls.normalize_web(u).alias("url_web"), urls.normalize_legacy(u).alias("url_legacy")
    )


SHEET = rf"""
WITH a AS (SELECT line_id, url, {U} AS t FROM lead_lines), b AS (SELECT line_id, url, split_part(CASE WHEN regexp_matches(t, '^https?://') THEN t WHEN starts_with(t, '//') THEN 'https:' || t ELSE 'https://' || t END, '#', 1) AS u FROM a),
c AS (SELECT *, {PATH.format(u='u')} AS p, array_to_string(list_filter(string_split({QS.format(u='u')}, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid') AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_')), '&') AS q FROM b)
SELECT line_id, CASE WHEN coalesce(url, '') = '' THEN '' ELSE regexp_extract(u, '^(https?)://', 1) || '://' || {NET.format(u='u')} || CASE WHEN p = '/' THEN '/' ELSE regexp_replace(p, '/+$', '') END || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS url_sheet FROM c
"""


@query(SHEET)
def url_sheet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lead_lines").select("line_id", urls.normalize_sheet(F.col("url")).alias("url_sheet"))


CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({v}, '^.*@', ''), '[/?#].*$', ''), ':.*$', ''), '^\.+|\.+$', '', 'g'), '^www\.', '')"""


@query(rf"""
WITH t AS (SELECT lead_id, url, lower({TRIM.format(u='domain')}) AS v FROM leads),
c AS (SELECT lead_id, url, {CLEAN.format(v="CASE WHEN contains(v, '://') THEN regexp_extract(v, '://([^/?#]*)', 1) ELSE v END")} AS c FROM t)
SELECT lead_id, lower({NET.format(u='url')}) AS plain, replace(lower({NET.format(u='url')}), 'www.', '') AS any_www, CASE WHEN contains(c, '.') THEN c ELSE '' END AS cleaned FROM c
""")
def domain_variants(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    cleaned = F.when(F.col("domain").isNotNull(), urls.clean_domain(F.col("domain"))).otherwise("")
    return table(spark, d, "leads").select("lead_id", urls.domain_plain(u).alias("plain"), urls.domain_any_www(u).alias("any_www"), cleaned.alias("cleaned"))


@query(r"""
WITH k AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS h FROM city_pages WHERE url IS NOT NULL),
p AS (SELECT page_id, string_split(h, '.') AS x FROM k)
SELECT page_id, array_to_string(x[i:], '.') AS suffix FROM p, unnest(range(1, len(x) + 1)) AS r(i)
""")
def domain_suffixes(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "city_pages").where("url is not null")
    return pages.select("page_id", F.explode(urls.suffixes(urls.domain_key(F.col("url")))).alias("suffix"))


ORIGINS = ["https://shop.example/a", "ftp://x.example/", "http://192.168.0.1/", "http://localhost:8080/", "http://printer.local/x", "https://intranet/", "http://", "", "https://My-Shop.Example:8443/p?q=1", "http://[::1]/"]


@query(rf"""
WITH i AS (SELECT * FROM (VALUES {', '.join(f"({n}, '{u}')" for n, u in enumerate(ORIGINS))}) AS v(n, url) UNION ALL SELECT lead_id + 100, url FROM leads),
a AS (SELECT n, url, regexp_replace({NET.format(u=U)}, '^.*@', '') AS auth FROM i),
h AS (SELECT n, url, auth, lower(CASE WHEN starts_with(auth, '[') THEN regexp_extract(auth, '^\[([^\]]*)\]', 1) ELSE regexp_replace(auth, ':[0-9]*$', '') END) AS host, regexp_extract(auth, ':([0-9]+)$', 1) AS port FROM a),
e AS (SELECT *, CASE WHEN coalesce(url, '') = '' THEN 'INVALID_URL' WHEN NOT regexp_matches(lower({U}), '^https?:') THEN 'INVALID_SCHEME' WHEN host = '' THEN 'MISSING_HOST'
  WHEN regexp_matches(host, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$') OR contains(host, ':') THEN 'IP_HOST' WHEN host = 'localhost' OR regexp_matches(host, '\.(local|internal|lan)$') THEN 'NON_PUBLIC_HOST' WHEN NOT contains(host, '.') THEN 'INVALID_TLD' END AS error FROM h)
SELECT n, CASE WHEN error IS NULL THEN 'https://' || host || CASE WHEN port <> '' AND port <> '0' THEN ':' || port ELSE '' END END AS origin, error FROM e
""")
def origin_check(spark: SparkSession, d: str) -> DataFrame:
    literal = spark.createDataFrame(list(enumerate(ORIGINS)), "n bigint, url string")
    rows = literal.unionByName(table(spark, d, "leads").select((F.col("lead_id") + 100).alias("n"), "url"))
    return rows.select("n", urls.origin(F.col("url")).alias("o")).select("n", "o.*")


P = "lower(" + PATH.format(u="url") + ")"
DOM = f"replace(lower({NET.format(u='url')}), 'www.', '')"


@query(rf"""
SELECT page_id, CAST(CASE WHEN regexp_replace({P}, '/+$', '') = '' THEN 0 {' '.join(f"WHEN contains(regexp_replace({P}, '/+$', ''), '{x}') THEN {i + 1}" for i, x in enumerate(rules.PREFERRED_PATHS))} ELSE 100 END AS INTEGER) AS path_priority,
  CAST(CASE WHEN ends_with({DOM}, '.jp') THEN -2 ELSE 2 END AS INTEGER) AS k_national, CAST(CASE WHEN {any_of(DOM, rules.JP_PLATFORMS[:11])} THEN 1 ELSE 0 END AS INTEGER) AS k_builder,
  CAST(CASE WHEN {any_of(f"regexp_replace({P}, '/+$', '')", rules.BUSINESS_PATHS)} THEN -1 ELSE 0 END AS INTEGER) AS k_business,
  CAST(len(regexp_replace({P}, '/+$', '')) - len(replace(regexp_replace({P}, '/+$', ''), '/', '')) AS INTEGER) AS k_depth
FROM city_pages WHERE url IS NOT NULL
""")
def url_priorities(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    keys = urls.process_priority(u)
    names = ["k_national", "k_builder", "k_business", "k_depth"]
    return table(spark, d, "city_pages").where("url is not null").select("page_id", urls.path_priority(u).alias("path_priority"), *[k.alias(n) for k, n in zip(keys, names)])


@query(rf"""
SELECT line_id, coalesce({' OR '.join(f"ends_with({P}, '{x}')" for x in rules.JUNK_EXTENSIONS)} OR {any_of('lower(url)', rules.JUNK_PATHS)}, true) AS junk,
  coalesce(NOT ends_with({DOM}, '.jp') AND NOT {suffix_of(DOM, rules.JP_PLATFORMS)} AND ({' OR '.join(f"ends_with({DOM}, '{t}')" for t in rules.FOREIGN_TLDS)}), false) AS foreign_site
FROM lead_lines
""")
def url_flags(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "lead_lines").select("line_id", urls.is_junk(u).alias("junk"), urls.is_foreign(u).alias("foreign_site"))


@query(r"""
WITH c AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(trim(domain, E' \t\r\n　')), ':.*$', ''), '^\.+|\.+$', '', 'g') AS v FROM leads WHERE domain IS NOT NULL),
k AS (SELECT DISTINCT regexp_replace(v, '^www\.', '') AS dom FROM c WHERE contains(v, '.')),
l AS (SELECT dom, string_split(dom, '.')[-2] AS label FROM k)
SELECT dom AS domain, array_to_string(list_transform(list_filter(string_split(regexp_replace(label, '[^a-zA-Z0-9]+', '-', 'g'), '-'), lambda w: w <> ''), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS name FROM l
""")
def domain_names(spark: SparkSession, d: str) -> DataFrame:
    domains = table(spark, d, "leads").select(urls.clean_domain(F.col("domain")).alias("domain")).where("domain <> ''").distinct()
    return domains.select("domain", urls.domain_display_name(F.col("domain")).alias("name"))


@query(r"""
WITH t AS (SELECT lead_id, regexp_replace(regexp_replace(regexp_replace(display_name, '[\s\p{Z}]+', ' ', 'g'), '^ +| +$', '', 'g'), '', '') AS one, lower(coalesce(store_name, '')) AS s, coalesce(phone, '') AS ph FROM leads)
SELECT lead_id, CASE WHEN len(one) > 12 THEN one[1:11] || '…' ELSE one END AS sanitized,
  translate(regexp_replace(s, '[・\-_\s\p{Z}.,!?''"()\[\]{}/\\【】「」『』（）]', '', 'g'), '０１２３４５６７８９', '0123456789') AS name_key FROM t
""")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").select("lead_id", text.sanitize(F.col("display_name"), 12).alias("sanitized"), text.store_name_key(F.col("store_name")).alias("name_key"))


@query(r"""
WITH t AS (SELECT lead_id, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')[1:11] AS d FROM leads)
SELECT lead_id, CASE WHEN len(d) < 10 OR d[1:4] IN ('0000', '1111', '2222', '3333', '4444', '5555', '6666', '7777', '8888', '9999') THEN ''
  WHEN len(d) = 10 AND d[1:2] IN ('03', '04', '06') THEN d[1:2] || '-' || d[3:6] || '-' || d[7:] WHEN len(d) = 10 AND d[1:3] IN ('012', '050') THEN d[1:4] || '-' || d[5:7] || '-' || d[8:]
  WHEN len(d) = 10 THEN d[1:3] || '-' || d[4:6] || '-' || d[7:] WHEN d[1:3] IN ('070', '080', '090') THEN d[1:3] || '-' || d[4:7] || '-' || d[8:] ELSE d[1:4] || '-' || d[5:6] || '-' || d[7:] END AS phone FROM t
""")
def phone_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "leads").select("lead_id", text.phone(F.col("phone")).alias("phone"))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) > 20 THEN round_even(len(list_distinct(w)) / len(w), 6) END AS ratio FROM w
""")
def repeat_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.repeat_ratio(F.col("text")).alias("ratio"))


@query(r"""
SELECT doc_id, CASE WHEN position('variance' IN text) > 0 THEN regexp_replace(regexp_replace(substr(text, greatest(position('variance' IN text) - 18, 1), position('variance' IN text) + 26 - greatest(position('variance' IN text) - 18, 1)), '[\s\p{Z}]+', ' ', 'g'), '^ +| +$', '', 'g') END AS snippet,
  CASE WHEN len(text) > 0 THEN round_even((len(text) - len(regexp_replace(text, '[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}]', '', 'g'))) / len(text), 6) ELSE 0.0 END AS jp_ratio,
  list_min(list_filter(list_transform(regexp_extract_all(lower(text), '(?:©|\(c\)|copyright)[^0-9]{0,20}?((?:19|20)[0-9]{2})', 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1990 AND 2100)) AS first_year,
  CAST(coalesce((len(text) - len(replace(text, '\cite', ''))) / 5, NULL) AS INTEGER) AS cites
FROM documents
""")
def text_features(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", text.snippet(t, "variance").alias("snippet"), text.japanese_ratio(t).alias("jp_ratio"), text.earliest_year(t).alias("first_year"), text.occurrences(t, "\\cite").alias("cites")
    )


@query(r"""
SELECT event_id, substr(sha256(props), 1, 12) AS props_hash, CAST(json_extract(regexp_extract('answer: ' || props || ' end', '\{.*\}'), '$.k') AS BIGINT) AS k,
  strftime(ts, '%Y-%m-%d') AS day, ts - INTERVAL 9 HOUR AS utc_time FROM events
""")
def json_hash_time(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.concat(F.lit("answer: "), F.col("props"), F.lit(" end"))
    return table(spark, d, "events").select(
        "event_id", text.short_hash(F.col("props")).alias("props_hash"), F.get_json_object(text.json_object(noisy), "$.k").cast("bigint").alias("k"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("ts") - F.expr("interval 9 hours")).alias("utc_time"),
    )


@query(r"""
WITH t AS (SELECT lead_id, strftime(fetched_at_iso, '%Y/%m/%d %H:%M:%S') AS txt, CAST(lead_score AS VARCHAR) AS sc FROM leads)
SELECT lead_id, strptime(txt, '%Y/%m/%d %H:%M:%S') - INTERVAL 9 HOUR AS utc_time, CAST(strptime(txt, '%Y/%m/%d %H:%M:%S') AS DATE) AS day, CAST(greatest(0, least(100, coalesce(try_cast(sc AS INTEGER), 0))) AS INTEGER) AS score FROM t
""")
def parsed_fields(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "leads").select("lead_id", F.date_format("fetched_at_iso", "yyyy/MM/dd HH:mm:ss").alias("txt"), F.col("lead_score").cast("string").alias("sc"))
    return t.select("lead_id", text.jst_time(F.col("txt")).alias("utc_time"), text.literal_date(F.replace("txt", F.lit("/"), F.lit("-"))).alias("day"), text.score_0_100(F.col("sc")).alias("score"))


@query(r"""SELECT lead_id, coalesce(nullif(trim(store_name), ''), nullif(trim(display_name), ''), '') AS name, CASE WHEN trim(store_name) <> '' THEN 'store_name' WHEN trim(display_name) <> '' THEN 'display_name' END AS source
FROM (SELECT lead_id, regexp_replace(store_name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS store_name, regexp_replace(display_name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS display_name FROM leads)""")
def alias_pick(spark: SparkSession, d: str) -> DataFrame:
    leads = table(spark, d, "leads")
    names = ["店舗名", "Store_Name", "display_name"]
    both = text.pick_with_source(leads, names)
    return leads.select("lead_id", text.pick(leads, names).alias("name"), both["source"].alias("source"))


BLOCKED, GOV, NEWS = ["kuchikomi-navi.example", "machi-reserve.example", "beauty-ichiba.example"], [".go.jp", ".lg.jp"], ["local-kagami.example"]
KEYS = [rules.Rule("口コミ", "review"), rules.Rule("完全個室", "private"), rules.Rule("salon", "salon"), rules.Rule("ピアノ", "piano")]
FR_DOM = f"regexp_replace({NET.format(u='lower(website)')}, '^www\\.', '')"


@query(rf"""
WITH t AS (SELECT name_id, {FR_DOM} AS dom, lower(coalesce(original_title, '')) AS title FROM site_names)
SELECT name_id, CASE WHEN {' OR '.join(f"ends_with(dom, '{g}')" for g in GOV)} THEN 'domain:gov' {' '.join(f"WHEN dom = '{b}' OR ends_with(dom, '.{b}') THEN 'domain:{b}'" for b in BLOCKED)}
  WHEN {suffix_of('dom', NEWS)} AND NOT regexp_matches(title, '[\x{{3040}}-\x{{30FF}}]') THEN 'domain:media' {' '.join(f"WHEN contains(title, '{r.pattern}') THEN 'keyword:{r.reason}'" for r in KEYS)}
  WHEN regexp_matches(title, '[0-9]{{1,3}}選') THEN 'list_page' ELSE '' END AS filter_reason FROM t
""")
def filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "site_names").select("name_id", F.col("website").alias("url"), F.coalesce("original_title", F.lit("")).alias("title"))
    chain = filters.reason_chain(F.col("url"), F.col("title"), government=GOV, blocked=BLOCKED, media=NEWS, keywords=KEYS)
    return names.select("name_id", chain.alias("filter_reason"))


@query(rf"""
WITH t AS (SELECT lead_id, http_status AS s, lower(coalesce(source_query, '')) AS b FROM leads)
SELECT lead_id, CASE WHEN s >= 400 THEN CASE WHEN s IN (403, 429) OR (s IN (401, 503) AND contains(b, 'salon')) THEN 'BLOCKED' ELSE 'INVALID' END ELSE 'OK' END AS response,
  CASE WHEN s >= 400 THEN CASE WHEN s IN (403, 429) OR (s IN (401, 503) AND contains(b, 'salon')) THEN 'BLOCKED_' ELSE 'HTTP_' END || CAST(s AS VARCHAR) ELSE 'OK' END AS code,
  coalesce(NOT (s IN (404, 410) OR s >= 500), false) AS alive FROM t
""")
def response_classes(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("http_status")
    kind, code = classify.response_class(s, F.lit("text/html"), F.col("source_query"), ["salon"])
    return table(spark, d, "leads").select("lead_id", kind.alias("response"), code.alias("code"), classify.alive(s).alias("alive"))


@query(r"""
SELECT name_id, CASE WHEN ends_with(dom, '.jp') THEN 'japanese' WHEN dom = 'page-maker.example' OR ends_with(dom, '.page-maker.example') THEN 'japanese' WHEN dom = 'yoyaku-lane.example' OR ends_with(dom, '.yoyaku-lane.example') THEN 'overseas'
  WHEN (CASE WHEN len(title) > 0 THEN (len(title) - len(regexp_replace(title, '[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}]', '', 'g'))) / len(title) ELSE 0 END) >= 0.3 THEN 'japanese' ELSE 'uncertain' END AS language_class
FROM (SELECT name_id, original_title AS title, regexp_replace(lower(regexp_extract(website, '://([^/?#]*)', 1)), '^www\.', '') AS dom FROM site_names)
""")
def url_language(spark: SparkSession, d: str) -> DataFrame:
    cls = classify.url_language(F.col("website"), F.col("original_title"), ["page-maker.example"], ["yoyaku-lane.example"])
    return table(spark, d, "site_names").select("name_id", cls.alias("language_class"))
