"""Queries of display names out of titles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..session import table
from .registry import query
from .url_queries import CLEAN, TRIM

SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
ENDS = r"[ \-–—|｜:：／/\[\]【】]+"
CLEANED = "regexp_replace(regexp_replace(regexp_replace({x}, '[\\x{{FEFF}}\\x{{200B}}]', '', 'g'), '" + SPACE.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g'), '^" + ENDS + "|" + ENDS + "$', '', 'g')"
BARE = rf"regexp_replace(coalesce(original_title, ''), '^[\x{{FEFF}}\x{{200B}}{SPACE[1:]}*(?:【[^】]*】|\[[^\]]*\]){SPACE}*', '')"
#: Candidates of each title in order, each once.
CANDIDATES = rf"""
WITH b AS (SELECT name_id, domain, original_title, {CLEANED.format(x=BARE)} AS bare FROM site_names),
c AS (SELECT name_id, domain, original_title, list_filter(list_transform(list_concat(regexp_extract_all(bare, '[「『“"]([^」』”"]{{2,40}})[」』”"]', 1), regexp_split_to_array(bare, ' *[|｜–—] *| +[-/] +')), lambda y: {CLEANED.format(x="y")}), lambda y: y <> '') AS l FROM b),
d AS (SELECT name_id, domain, original_title, list_filter(l, lambda y, i: list_position(l, y) = i) AS l FROM c),
e AS (SELECT name_id, domain, original_title, unnest(l) AS candidate, generate_subscripts(l, 1) - 1 AS ord FROM d),
w AS (SELECT *, lower(candidate) AS low, coalesce(lower(split_part(domain, '.', 1)), '') AS word FROM e),
s AS (SELECT *, 50 + CASE WHEN len(candidate) BETWEEN 2 AND 24 THEN 20 WHEN len(candidate) > 40 THEN -30 ELSE 0 END - CASE WHEN low IN ({', '.join(f"'{g}'" for g in names.GENERIC)}) THEN 60 ELSE 0 END - CASE WHEN regexp_matches(candidate, '[市区町村]の') THEN 25 ELSE 0 END
  - CASE WHEN regexp_matches(candidate, '^[\p{{Han}}\p{{Katakana}}]{{1,8}}[市区町村]$') THEN 20 ELSE 0 END + CASE WHEN len(word) > 3 AND contains(regexp_replace(low, '[^a-z0-9]', '', 'g'), word) THEN 15 ELSE 0 END AS score FROM w)
"""


@query(CANDIDATES + "SELECT name_id, CAST(ord AS INTEGER) AS ord, candidate, CAST(score AS INTEGER) AS score FROM s WHERE original_title IS NOT NULL")
def name_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every part of a title that may be its name, with its score."""
    t = table(spark, d, "site_names").where("original_title is not null").select("name_id", "domain", F.posexplode(names.candidates(F.col("original_title"))).alias("ord", "candidate"))
    return t.select("name_id", "ord", "candidate", names.name_score(F.col("candidate"), F.col("domain")).alias("score"))


LABEL = "CASE WHEN len(p) >= 3 AND p[-1] = 'jp' AND p[-2] IN ('co', 'or', 'ne', 'ac', 'go', 'gr', 'ed', 'lg', 'ad') THEN p[-3] WHEN len(p) >= 2 THEN p[-2] ELSE p[1] END"


@query(CANDIDATES + rf""", best AS (SELECT name_id, arg_max(candidate, struct_pack(a := score, b := -ord)) AS candidate, max(score) AS score FROM s GROUP BY name_id),
k AS (SELECT name_id, {CLEAN.format(v=f"lower({TRIM.format(u='domain')})")} AS c FROM site_names), q AS (SELECT name_id, list_filter(string_split(CASE WHEN contains(c, '.') THEN c ELSE '' END, '.'), lambda x: x <> '') AS p FROM k),
n AS (SELECT name_id, coalesce(array_to_string(list_transform(list_filter(string_split(regexp_replace({LABEL}, '[^a-zA-Z0-9]+', '-', 'g'), '-'), lambda x: x <> ''), lambda x: upper(x[1:1]) || lower(x[2:])), ' '), '') AS dn FROM q),
f AS (SELECT n.name_id, coalesce(best.score >= 40, false) AS good, best.candidate, CASE WHEN best.score >= 40 THEN best.score ELSE 30 END AS score, dn FROM n LEFT JOIN best ON n.name_id = best.name_id)
SELECT name_id, CASE WHEN good THEN candidate ELSE dn END AS name, CAST(score AS INTEGER) AS score, CASE WHEN good THEN 'title' ELSE 'domain' END AS source, CASE WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS confidence FROM f
""")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    """The best name of each title, else words of the domain."""
    best = names.best_name(F.col("original_title"), F.col("domain"))
    return table(spark, d, "site_names").select("name_id", best.alias("b")).select("name_id", "b.*")
