"""Lossless sources, appends, engines, retries, and page fields on small inputs."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from leadloom.functions import html, names, page, retry, text, urls
from leadloom.operators import dedupe, rank
from leadloom.plans import flows
from leadloom.sources import files, search, sinks


def test_encoding_of_whole_files_anywhere(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    (folder / "late.csv").write_bytes(b"name,x\n" + b"abc,1\n" * 9000 + "鮨,2\n".encode("cp932"))
    (folder / "u8.csv").write_bytes('﻿name,y\n"花\n屋",z\n'.encode())
    (folder / "p+q[1].csv").write_bytes("y,name\nq,店\n".encode("cp932"))
    (folder / "_hidden.csv").write_bytes(b"\xff")
    for where in (str(folder), f"file:{folder}", f"file:{folder}/*.csv"):
        got = files.read_csv(spark, where)
        assert got.count() == 9003 and set(got.columns) == {"name", "x", "y"}
        assert sorted(r.name for r in got.where("name <> 'abc'").collect()) == sorted(["花\n屋", "店", "鮨"])
    many = files.read_many(spark, [f"{folder}/*.csv"])
    assert {(r.file_no, r.n) for r in many.groupBy("file_no").agg(F.count("*").alias("n")).collect()} == {(0, 9001), (1, 1), (2, 1)}
    (folder / "bad.csv").write_bytes(b"n\n\xff\xff\x81\n")
    with pytest.raises(ValueError, match="bad.csv"):
        files.read_csv(spark, str(folder))
    (tmp_path / "empty.csv").write_bytes(b"")
    assert files.read_csv(spark, str(tmp_path / "empty.csv"), ["a"]).columns == ["a"]


def test_appending_again_adds_nothing(spark, tmp_path):
    data = [("https://a.example/", "x"), ("https://a.example/#top", "y"), (" https://b.example", "x"), (None, "x"), (None, "x"), ("", "z")]
    df = spark.createDataFrame(data, "url string, name string")
    at = f"file:{tmp_path}/out"
    for _ in range(3):
        sinks.append_unseen(df, at)
        assert spark.read.parquet(at).count() == 4
    sinks.append_unseen(spark.createDataFrame([("https://c.example/", "x", 1)], "url string, name string, more int"), at)
    assert spark.read.option("mergeSchema", True).parquet(at).count() == 5


def test_engines(spark, tmp_path):
    class One(search.Engine):
        def available(self):
            return True

        def search(self, query, most):
            yield f"https://{query}.example/", "t"

    spark.dataSource.register(search.search_source(mine=lambda options, queries: One()))
    got = spark.read.format("search").option("queries", json.dumps(["p", "q"])).load().collect()
    assert sorted((r.query, r.url, r.engine) for r in got) == [("p", "https://p.example/", "mine"), ("q", "https://q.example/", "mine")]
    bing = {"webPages": {"value": [{"url": f"https://x{i}.example", "name": "n"} for i in range(2)]}}
    asked = []
    get = lambda url, headers: asked.append((url, headers)) or json.dumps(bing)
    assert len(list(search.Bing("k", get).search("花", 3))) == 3 and "mkt=ja-JP" in asked[0][0] and asked[0][1]["Ocp-Apim-Subscription-Key"] == "k"
    assert not search.Bing("", get).available() and search.DuckDuckGo().available()
    assert list(search.Brave("k", lambda u, h: json.dumps({"web": {"results": [{"url": "https://y.example"}]}})).search("q", 1)) == [("https://y.example", "")]
    answer = '<a rel="n" class="result__a" href="//d.example/l/?uddg=https%3A%2F%2Fz.example%2Fp&amp;rut=1">Z <b>z</b> &amp; y</a>'
    assert search.DuckDuckGo(get=lambda u, h: answer).hits(answer) == [("https://z.example/p", "Z z & y")]
    (tmp_path / "h.jsonl").write_text("\n".join(json.dumps({"query": q, "url": f"https://{q}{i}.example", "title": "", "engine": "e", "place": i}) for q in "ab" for i in range(3)))
    hits = search.recorded_hits(spark, str(tmp_path / "h.jsonl"), spark.createDataFrame([("a",), ("a",)], "query string"), most=2)
    assert hits.count() == 2


def test_retries():
    waited, tries = [], []

    def call(x):
        tries.append(x)
        if len(tries) < 4:
            raise OSError("no")
        return x

    assert retry.retrying(call, 5, sleep=waited.append)(7) == 7 and waited == [1.0, 2.0, 4.0]
    with pytest.raises(OSError):
        retry.with_retries(1, sleep=waited.append)(lambda: (_ for _ in ()).throw(OSError()))()
    assert retry.waits(6) == [1.0, 2.0, 4.0, 8.0, 10.0, 10.0]


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{k} string" for k in values) or "x string")
    return df.select(c.alias("c")).first().c


def test_functions(spark):
    assert one(spark, text.clean_spaces(F.col("x")), x="【店舗　名】｜") == "店舗 名"
    assert [one(spark, text.score_0_100(F.col("x")), x=v) for v in ("3000000000", "-3", "x", "9" * 60, " 7 ")] == [100, 0, 0, 100, 7]
    assert one(spark, text.decimal_number(F.col("x")), x="1,234.5") == 1234.5
    assert one(spark, urls.domain_display_name(F.col("x")), x="abc-def.co.jp") == "Abc Def"
    assert [one(spark, urls.path_priority(F.col("x")), x=v) for v in ("https://a.example", "https://a.example/", "https://a.example/zzz")] == [0, 0, 1]
    assert [one(spark, urls.strict_domain(F.col("x")), x=v) for v in ("www.A.example", "a_b.example", "-a.example")] == ["a.example", "", ""]
    assert [r for r in one(spark, names.candidates(F.col("x")), x="【公式】花　サロン｜福岡")] == ["花 サロン", "福岡"]
    p = '<title>T</title><h1>H</h1><main>m <b>n</b></main><footer>f</footer><a href="MAILTO:x">x</a><a href="mailto:a@b.example?x">m</a>'
    assert one(spark, page.first_email(F.col("x")), x=p) == "a@b.example" and one(spark, page.first_email(F.col("x")), x="test@a.example b@c.example") == "b@c.example"
    assert one(spark, page.blocks(F.col("x")).getField("combined"), x=p) == "T H m n f"
    assert one(spark, page.first_phone(F.col("x")), x='03-1234-5678 <a href="tel:+81 3 0000">') == "+8130000"
    link = lambda base, href: one(spark, page.resolve(F.col("b"), F.col("h")), b=base, h=href)
    assert [link("https://a.example/p/q?x", h) for h in ("r", "/r", "//c.example/d", "?y", "https://e.example", "")] == ["https://a.example/p/r", "https://a.example/r", "https://c.example/d", "https://a.example/p/q?y", "https://e.example", "https://a.example/p/q?x"]
    assert one(spark, html.postal_code(F.col("x")), x="〒８１０－０００１") == "810-0001"
    assert one(spark, flows.outcome(F.col("a"), F.col("b")), a="Skipped_dup", b="") == ("skipped", "", "Skipped_dup", "")


def test_null_keys_and_positions(spark):
    df = spark.createDataFrame([(i, None if i < 8 else "k", i) for i in range(12)], "id int, key string, s int")
    assert sorted(r.id for r in rank.top_share(df, ["key"], [F.col("s")], 0.5).collect()) == [0, 1, 2, 3, 8, 9]
    got = dedupe.keep_position(spark.createDataFrame([("a", 1, 5), ("a", 9, 7), ("", 3, 1)], "k string, s int, seq int"), F.col("k"), F.col("s"), F.col("seq"))
    assert rows(got.select("s", "position")) == [(9, 5)]


def test_empty_tables(spark):
    leads = spark.createDataFrame([], "seq bigint, run int, url string, score int, lead_id string, status string, reason string")
    checks = spark.createDataFrame([], "url string, status int, final_url string")
    assert flows.validated(leads, checks, "run").count() == 0 and flows.validation_totals(leads, checks, "run").first().run is None
    assert flows.carried_ids(leads, spark.createDataFrame([], "id string, url string")).count() == 0
    assert flows.outcomes(leads.select("lead_id", "status", "reason"), leads.select("lead_id", "status", "reason", "seq"), "r").count() == 0
    made = flows.with_headers(spark.createDataFrame([("花", None, "https://a.example", "7点")], "`店舗名` string, `元のURL` string, website string, `スコア` string"))
    assert made.first().asDict() == {"store_name": "花", "url": "https://a.example", "website": "https://a.example", "score": 0}
