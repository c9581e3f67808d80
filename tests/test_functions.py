"""Literals of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from leadloom.functions import html, names, rules, text, urls


def one(spark, f, *values, kind="string"):
    cols = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{c} {kind}" for c in cols))
    return df.select(f(*map(F.col, cols)).alias("v")).first().v


@pytest.mark.parametrize("url,want", [
    ("example.com", "https://example.com/"), ("https://EXAMPLE.COM/Page", "https://example.com/Page"), ("http://www.example.com/page/", "https://example.com/page"), ("https://example.com#top", "https://example.com/"),
    ("https://example.com/?utm_source=x&id=3&REF=y", "https://example.com/?id=3"), ("", ""), (None, ""),
])
def test_strict(spark, url, want):
    assert one(spark, urls.normalize_strict, url) == want


def test_domains(spark):
    assert one(spark, urls.clean_domain, "https://user@WWW.shop.co.jp:8080/x?y") == "shop.co.jp"
    assert one(spark, urls.clean_domain, "localhost") == "" and one(spark, urls.domain_display_name, "my-shop_two.co.jp") == "My Shop Two"
    assert one(spark, lambda a, b: urls.first_domain(a, b), "tel:03-1", "http://b.example/") == "b.example"
    assert one(spark, urls.suffixes, "a.b.c") == ["a.b.c", "b.c", "c"]
    assert one(spark, urls.same_site, "blog.a.example", "a.example") and not one(spark, urls.same_site, "ba.example", "a.example")
    assert one(spark, urls.is_web_url, "http://localhost/") is False and one(spark, urls.is_web_url, None) is False
    assert one(spark, lambda u: urls.origin(u)["origin"], "https://My-Shop.Example:8443/p") == "https://my-shop.example:8443"
    assert [one(spark, urls.path_priority, u) for u in ("https://a.example", "https://a.example/menu")] == [0, 1]


def test_text(spark):
    assert one(spark, lambda c: text.sanitize(c, 5), " a\n\tb   cdef ") == "a b …"
    assert one(spark, text.store_name_key, "【ABC Store】１２") == "abcstore12" and one(spark, text.store_name_key, None) == ""
    assert [one(spark, text.phone, p) for p in ("0312345678", "09012345678", "0000000000", "123", None)] == ["03-1234-5678", "090-1234-5678", "", "", ""]
    assert [one(spark, text.score_0_100, p) for p in ("150", "-10", "invalid", None, "7.5")] == [100, 0, 0, 0, 0]
    assert [one(spark, text.truth, p) for p in ("あり", "False", "?", None)] == ["1", "0", "", ""]
    assert one(spark, lambda c: text.token_match(c, ["hp", "salon"]), "php mysalon") and not one(spark, lambda c: text.token_match(c, ["hp"]), "php")
    assert one(spark, text.earliest_year, "© 2019-2023 Copyright 2011") == 2011
    assert one(spark, lambda c: text.evidence(c, "form"), "area=x | form=yes | note=a") == "yes"
    assert str(one(spark, text.jst_time, "2025/01/02 03:04:05")) == "2025-01-01 18:04:05" and one(spark, text.jst_time, "soon") is None
    df = spark.createDataFrame([("", "b", "c")], "`ＵＲＬ` string, `﻿url` string, other string")
    assert df.select(text.pick(df, ["URL", "other"]).alias("v")).first().v == "b"


def test_rules(spark):
    rs = [rules.Rule("b", "bee", 5), rules.Rule("a", "", 9)]
    assert one(spark, lambda c: rules.first_match(c, rs), "xAB") == "bee" and one(spark, lambda c: rules.first_match(c, rs), None) is None
    assert one(spark, lambda c: rules.points(c, rs, 10), "ab") == 10 and one(spark, lambda c: rules.points(c, rs), None) == 0
    assert one(spark, lambda c: rules.contains_any(c, []), "a") is False
    assert [r.pattern for r in rules.patched(rs, [rules.Rule("a"), rules.Rule("c")])] == ["b", "a", "c"]
    assert rules.as_table(spark, rs).count() == 2


def test_html(spark):
    page = '<html><head><title> A  b </title><meta content="N" property="og:site_name"><script>x</script></head><body><h1>H<b>1</b></h1><p>t &amp; u</p><a href="/x#y">l</a><a href="http://o.example/">o</a><a href="tel:03-1111-2222">t</a><script type="application/ld+json">{"@graph":[{"@type":"LocalBusiness","name":"Shop"}]}</script></body>'
    assert one(spark, lambda c: html.element(c, "title"), page) == "A b" and one(spark, lambda c: html.meta(c, "og:site_name"), page) == "N"
    assert one(spark, html.phone_link, page) == "03-1111-2222" and one(spark, html.emails, "A@b.co x a@B.co y@z.png") == ["a@b.co"]
    df = spark.createDataFrame([(1, "https://s.example/a/", page), (2, None, None), (3, "https://s.example", "<p>un<b>closed")], "id bigint, url string, html string")
    got = {r.id: r for r in html.read_pages(df, "id").collect()}
    assert got[1].links == ["https://s.example/x"] and got[1].names == ["Shop"] and got[1].text.startswith("A b H 1 t & u") and got[2].text == "" and got[3].text == "un closed"
    assert one(spark, lambda c: html.first_listed(c, ["z", "t", "A"]), page) == "t"


def test_names(spark):
    best = lambda t, d="page.example": one(spark, names.best_name, t, d)
    assert best("【口コミ】Raça Lehesi Atelier | 飯都町の整体院").name == "Raça Lehesi Atelier"
    assert best("トップページ", "healing-house.example").name == "Healing House" and best("トップページ").source == "domain"
    assert best(None).confidence == "low"


def test_nothing_found_is_null(spark):
    assert one(spark, lambda c: html.first_listed(c, ["q"]), "page") is None and one(spark, urls.domain_display_name, "") == "" and one(spark, urls.domain_display_name, "x") == ""


def test_page_texts(spark):
    assert one(spark, html.hours, "営業時間：平日 10:00〜19:30 まで") == "10:00〜19:30" and one(spark, html.hours, "10:00-12:00") == ""
    assert one(spark, html.postal_code, "〒００２－０６４３ x") == "002-0643" and one(spark, html.postal_code, "電話 03-0001-2345") == "" and one(spark, html.postal_code, "0051225 y") == "005-1225"
    assert one(spark, lambda t, b: html.listing_signals(b, t, ["ab", "cd", "ef"], 2, 2), "x", "ab " * 3 + "cd " * 3) and one(spark, lambda t, b: html.listing_signals(b, t, ["ab"]), "おすすめ12選", None)
    assert one(spark, lambda c: html.name_chain(c, F.lit("Dom")), "<title>T | x</title>") == "T" and one(spark, lambda c: html.name_chain(c, F.lit("")), "") == "Unknown"
