"""Capping against a sort by hand, with ties, nulls, repeated and negative identifiers, hot groups, shares."""

import random

from pyspark.sql import functions as F

from leadloom.llm import capping

SCHEMA = "grp bigint, who string, score int, id bigint, id2 string"


def by_hand(data, cap):
    groups = {}
    for g, w, s, i, _ in data:
        if w is not None:
            groups.setdefault((g, w), []).append((-(s or 0), i if i is not None else 2**63 - 1))
    out = []
    for v in groups.values():
        out += [None if i == 2**63 - 1 else i for _, i in sorted(v)[cap:]]
    return sorted(out, key=lambda x: (x is None, x))


def check(spark, data, cap):
    got = [r[0] for r in capping.over_cap(spark.createDataFrame(data, SCHEMA), max_count=cap).collect()]
    assert sorted(got, key=lambda x: (x is None, x)) == by_hand(data, cap)


def test_random_groups(spark):
    r = random.Random(1)
    data = [(r.choice([1, 2, None]), r.choice(["a", "b", "c", None]), r.choice([None, -5, 0, 50, 50, 100, 300]), r.choice([i, -i, i << 40]), "x") for i in range(1, 600)]
    check(spark, data, 15)


def test_one_contributor_with_equal_scores(spark):
    check(spark, [(1, "hot", 7, i * 977, "x") for i in range(700)] + [(1, f"w{i}", 7, 10**9 + i, "x") for i in range(20)], 15)


def test_repeated_rows_and_null_identifiers(spark):
    check(spark, [(1, "a", 50, 9, "x")] * 20 + [(1, "a", 50, None, "x")] * 3 + [(1, "b", None, None, "x")] * 4, 3)


def test_empty_and_share(spark):
    assert capping.over_cap(spark.createDataFrame([], SCHEMA), max_count=2).count() == 0
    data = [(1, "a", 50, i, "x") for i in range(8)] + [(1, "b", 50, 100 + i, "x") for i in range(2)]
    assert sorted(r[0] for r in capping.over_cap(spark.createDataFrame(data, SCHEMA), max_share=0.5).collect()) == [5, 6, 7]


def test_hosts(spark):
    cases = [("Shop.Example.", None, "shop.example"), (" www.shop.example:443", "x", "shop.example"), ("", "https://WWW.a.example:8080/p?q", "a.example"), ("\u3000", None, None),
             (None, "http://blog.a.example", "blog.a.example"), (None, None, None), ("www.www.x.example", None, "www.x.example")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, domain string, url string, want string")
    got = df.select("i", capping.host_of(F.col("domain"), F.col("url")).alias("got"), "want").collect()
    assert [r.got for r in sorted(got)] == [r.want for r in sorted(got)]


def test_scores_of_any_number(spark):
    values = [87.2, 87.9, 150.0, 900.0, -3.5, -0.0, 0.0, 1e-310, 5e-324, 2.0**-1022, 1.7e308, float("inf"), float("-inf"), 4.0, 3.9999999999999996, None, float("nan")]
    df = spark.createDataFrame([(1, "a", v, i) for i, v in enumerate(values)], "grp bigint, who string, score double, id bigint")
    real = [0.0 if v is None or v != v else v for v in values]
    order = sorted(range(len(values)), key=lambda i: (-real[i], i))
    for cap in (1, 4, 9, 14):
        assert sorted(r[0] for r in capping.over_cap(df, max_count=cap).collect()) == sorted(order[cap:])
    big = [2**63 - 1, -(2**63), 0, 5, 2**40]
    df = spark.createDataFrame([(1, "a", v, i) for i, v in enumerate(big)], "grp bigint, who string, score bigint, id bigint")
    assert sorted(r[0] for r in capping.over_cap(df, max_count=2).collect()) == [1, 2, 3]


def test_query_clamps_scores(spark, tmp_path):
    from leadloom.llm import queries

    data = [(1, i, "a.example", None, s) for i, s in enumerate([300, 100, 101, -5, 0, None] + [100] * 12)]
    spark.createDataFrame(data, "run_id bigint, lead_id bigint, domain string, url string, lead_score int").write.parquet(f"{tmp_path}/leads.parquet")
    assert sorted(r[0] for r in queries.p5_found(spark, str(tmp_path)).collect()) == [3, 4, 5]
