"""Sources, sinks and streams: round trips and recorded inputs."""

import json

from pyspark.sql import functions as F

from leadloom.sources import files, search, sinks
from leadloom.streaming import ingest


def test_csv_encodings_and_round_trip(spark, tmp_path):
    text = 'URL,店舗名,備考\nhttps://a.example/,花,"x, ""y""\nz"\nhttps://b.example/,,\n'
    for enc in ("utf-8-sig", "utf-8", "cp932"):
        p = tmp_path / f"{enc}.csv"
        p.write_bytes(text.encode(enc))
        got = files.read_csv(spark, str(p))
        assert got.columns == ["URL", "店舗名", "備考"] and got.orderBy("URL").first()["備考"] == 'x, "y"\nz'
    assert files.read_csv(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0
    df = spark.createDataFrame([(1, "花", ["a", "b"], None)], "id int, name string, why array<string>, x double")
    sinks.write_csv(df, str(tmp_path / "out"), {"name": "店舗名"}, ["name", "id", "why", "x"])
    back = files.read_csv(spark, str(tmp_path / "out"))
    assert back.columns == ["店舗名", "id", "why", "x"] and tuple(back.fillna("").first()) == ("花", "1", "a; b", "")
    many = files.read_many(spark, [str(tmp_path / "utf-8.csv"), str(tmp_path / "cp932.csv")])
    assert many.count() == 4 and set(many.columns) == {"URL", "店舗名", "備考", "file_no"}
    assert sorted(r.url for r in files.urls_of(files.read_csv(spark, str(tmp_path / "utf-8.csv"))).collect()) == ["https://a.example/", "https://b.example/"]


def test_lists_cooldowns_and_summaries(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# c\n\n a b \nwww.X.example/p # why\n")
    assert [r.value for r in files.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["a b", "www.X.example/p # why"]
    assert [r.domain for r in files.read_blocklist(spark, str(tmp_path / "l.txt")).collect()] == ["x.example"]
    (tmp_path / "c.json").write_text(json.dumps({"a.example": {"until": "2025-01-02T00:00:00Z", "reason": "r"}, "b.example": {"until": "2024-01-01T00:00:00Z"}, "c.example": {}}))
    assert sorted(r.domain for r in files.read_cooldowns(spark, str(tmp_path / "c.json"), F.lit("2025-01-01").cast("timestamp")).collect()) == ["a.example", "c.example"]
    (tmp_path / "s.md").write_text("# t\n## loop_01\n- theta: 0.5\n- passed: True\n\n## loop_02\n- theta: 0.7\n")
    assert {r.name: r.metrics for r in files.read_summaries(spark, str(tmp_path / "s.md")).collect()} == {"loop_01": {"theta": "0.5", "passed": "True"}, "loop_02": {"theta": "0.7"}}


def test_search_source(spark, tmp_path):
    hits = [{"query": "q1", "url": "https://www.a.example/", "title": "A"}, {"query": "q1", "url": "https://a.example", "title": "A2"}, {"query": "q2", "url": "https://b.example/", "title": "B"}]
    (tmp_path / "one.jsonl").write_text("\n".join(map(json.dumps, hits)))
    spark.dataSource.register(search.SearchSource)
    df = spark.read.format("search").option("queries", json.dumps(["q1", "q2"])).option("engines", "one,absent").load(str(tmp_path))
    assert df.count() == 3
    merged = search.merged_hits(df, F.contains("url", F.lit("b.example")), [F.col("engine"), F.col("place")]).collect()
    assert [(r.url, r.title) for r in merged] == [("https://www.a.example/", "A2")]


def test_append_tiers_json(spark, tmp_path):
    df = spark.createDataFrame([("https://a.example/?utm_x=1", "A"), ("https://b.example/", "B")], "url string, tier string")
    for _ in range(2):
        sinks.append_unseen(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.write_tiers(df, str(tmp_path / "tiers"), "tier")
    assert sorted(p.name for p in (tmp_path / "tiers").iterdir() if p.is_dir()) == ["tier=A", "tier=B"]
    doc = sinks.write_report(df.agg(F.count("*").alias("n"), F.lit(None).cast("int").alias("m")), str(tmp_path / "r.json"), ["n", "m"])
    assert doc == {"n": 2, "m": None} == json.loads((tmp_path / "r.json").read_text())
    js = sinks.result_json(spark.createDataFrame([(1, ["a", "b", "c"])], "id int, why array<string>"), "why", 2).first().json
    assert json.loads(js) == {"id": 1, "why": ["a", "b"]}


def test_streams(spark, tmp_path):
    data = [(i, f"2025-01-01 0{i % 3}:00:0{i}", "view", 1.0, f"https://a.example/{i % 2}") for i in range(6)]
    spark.createDataFrame(data, "id int, t string, kind string, value double, url string").withColumn("ts", F.col("t").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert run(ingest.first_seen(stream(), "ts"), "seen").count() == 2
    assert sum(r.n for r in run(ingest.windowed_counts(stream(), "ts", "kind"), "counts", "complete").collect()) == 6
    got = []
    q = ingest.upsert_latest(stream(), lambda df, i: got.append(df.count()), str(tmp_path / "up"))
    q.awaitTermination(120)
    assert sum(got) == 6


def test_registry_without_training_operators():
    import __spark_entry__ as e

    from leadloom import queries

    assert set(queries.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
