"""Queries over every row of their table, against brute force on small tables."""

import unicodedata
from collections import Counter

from conftest import rows

from leadloom.functions.rules import Rule
from leadloom.plans import pipeline, record_queries, relational_queries


def save(spark, folder, name, data, schema):
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


NAMES = ["Nail\xad Galu", "カ\u200cフ\u200dーク", "⼳楽教室・ヒロ", "𝖲𝖺𝗅𝗈𝗇 Hana", "美容室\U000e0100 花", "Relax \u2212 Roo\u2060m", "№1 ⓐ ½ Ⅳ", "\ufeffÇab\u180e 2", "整体\ufe00院", "Plain Name", "a_b", " ", "", None]


def slug(name):
    word = lambda c: c == "_" or unicodedata.category(c)[0] in "LMN"
    return "lf-" + "-".join("".join(c if word(c) else " " for c in name.strip().lower()).split()) if name.strip() else None


def test_lead_slugs(spark, tmp_path):
    d = save(spark, tmp_path, "leads", list(enumerate(NAMES)), "lead_id bigint, store_name string")
    want = [(i, slug(n)) for i, n in enumerate(NAMES) if n is not None]
    assert rows(relational_queries.lead_slugs(spark, d)) == sorted(want, key=repr)


def test_name_shapes(spark, tmp_path):
    shown = ["Nori　Salon", "\u00a0Nori\u00a0Salon Hana ", "ã\x83\x8d Nail", "a\x85b", "\u3000", "", "a b  c d e", "Nori\u2009Salon", "花", None]
    data = [(i, n, c) for i, (n, c) in enumerate((n, c) for n in shown for c in ("high", None))]
    d = save(spark, tmp_path, "site_names", data, "name_id bigint, display_name string, name_confidence string")
    want = Counter((c or "none", min(max(len(n.split()), 1), 4)) for _, n, c in data if n is not None)
    assert rows(record_queries.name_shapes(spark, d)) == sorted(((c, w, n) for (c, w), n in want.items()), key=repr)


LEADS = [(1, None, "Hana", None, 5), (2, "", "hana", "", 9), (3, None, "Hana", "飯都町", 1), (4, "https://a.example/", "Hana", None, 1), (5, None, None, "飯都町", 9), (6, None, "", None, 9), (7, None, "Yoga", None, 3), (8, None, "hana", "飯都町", 2),
         (9, None, "Hair", "New Elmo", 1), (10, None, "Hair", "NEW ELMO", 4), (11, "https://a.example/", None, None, 7)]
LEAD = "lead_id bigint, url string, store_name string, city string, lead_score int"


def best(leads):
    """Identifiers of the best lead of each address, else of each name with its city; the first on ties."""
    found = {}
    for i, url, name, city, score in leads:
        key = ("u", url) if url else ("n", name.lower(), (city or "").lower()) if name else None
        if key and (key not in found or score > found[key][0]):
            found[key] = (score, i)
    return sorted(i for _, i in found.values())


def test_best_two_keys_without_city(spark, tmp_path):
    d = save(spark, tmp_path, "leads", LEADS, LEAD)
    assert [i for (i,) in sorted(map(tuple, relational_queries.best_two_keys(spark, d).collect()))] == best(LEADS) == [2, 7, 8, 10, 11]


def lead_list(spark, leads, rules=pipeline.LeadRules()):  # noqa: B008
    return sorted(r["seq"] for r in pipeline.lead_list(spark.createDataFrame(leads, LEAD.replace("lead_id", "seq")), rules).collect())


def test_lead_list_without_city(spark):
    assert lead_list(spark, LEADS) == best(LEADS)
    # a name of signs alone is a name; cities are compared like names
    assert lead_list(spark, [(1, None, "!!", None, 1), (2, None, "【】", "", 2), (3, None, "Hair", "New-Elmo", 1), (4, None, "Hair", "new elmo", 1), (5, None, " ", "飯都町", 1)]) == [2, 3]


def test_lead_list_of_long_names(spark):
    long = "花" * 70
    leads = [(1, None, long + "東店", "飯都町", 1), (2, None, long + "西店", "飯都町", 2), (3, None, long + "写真館", "飯都町", 3), (4, None, long + " Salon", "飯都町", 4)]
    assert lead_list(spark, leads) == [1, 2, 3, 4]
    r = pipeline.LeadRules(keywords=[Rule("写真館", "photo")], boosts=[Rule("salon", "", 5)])
    made = pipeline.lead_list(spark.createDataFrame(leads, LEAD.replace("lead_id", "seq")), r)
    assert sorted((x["seq"], x["name"], x["score"]) for x in made.collect()) == [(1, long + "東店", 1), (2, long + "西店", 2), (4, long + " Salon", 9)]
