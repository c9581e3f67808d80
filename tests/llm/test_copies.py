"""Collapsing of records that differ in formatting only."""

from leadloom.llm import copies

SCHEMA = "id bigint, url string, store_name string, city string, attrs string, root string, extra int"


def collapse(spark, data):
    df = spark.createDataFrame([(*d, "x", 1) for d in data], SCHEMA)
    return sorted((r.first_id, r.copies) for r in copies.collapse(df).collect())


BASE = (1, "http://a-b.example/Shop_Page/top?id=1&lang=ja", "サロン 花", "福羽市", "phone: 03-0001-2222; Site_Type: blog")


def test_formatting_is_disregarded(spark):
    same = [
        BASE,
        (2, "HTTP://A-B.EXAMPLE/shop-page/top/?lang=ja&id=1 ", "【サロン】花", "福羽市。", "SITE_TYPE：BLOG、Phone:(03) 0001 2222."),
        (3, "\thttp://a-b.example/Shop_Page/top?id=1&lang=ja\n", "サロン・花", "　福羽市", "site_type: blog / phone: 0300012222;"),
    ]
    assert collapse(spark, same) == [(1, 3)]


def test_every_letter_scheme_and_owner_of_a_value_counts(spark):
    other = [
        BASE, (2, BASE[1].replace("http:", "https:"), *BASE[2:]), (3, BASE[1], "サロン 華", *BASE[3:]), (4, BASE[1], "サロンー花", *BASE[3:]),
        (5, *BASE[1:4], "fax: 03-0001-2222; site_type: blog"), (6, *BASE[1:4], "phone: blog; site_type: 03-0001-2222"), (7, BASE[1].replace("id=1&lang=ja", "id=ja&lang=1"), *BASE[2:]),
        (8, *BASE[1:4], BASE[4] + "; site_type: blog"), (9, BASE[1], "サロン 花é", *BASE[3:]), (10, BASE[1], "サロン 花e", *BASE[3:]), (11, BASE[1], "サロン ß", *BASE[3:]), (12, BASE[1], "サロン ss", *BASE[3:]),
    ]
    assert collapse(spark, other) == [(i, 1) for i in range(1, 13)]


def test_nulls_empty_and_long(spark):
    data = [(1, None, None, None, None), (2, None, None, None, None), (3, "", "", "", ""), (4, None, "", None, None), (None, "u", "s", "c", "a:b"), (6, "u", "s", "c", "a:b"),
            (7, "u", "x" * 200_000, "c", "k: v"), (8, "u", "X " * 1 + "x" * 199_999, "c", "k: v")]
    assert collapse(spark, data) == [(1, 2), (3, 1), (4, 1), (6, 2), (7, 2)]
    assert copies.collapse(spark.createDataFrame([], SCHEMA)).count() == 0
