"""A third of all rows in one group, without broadcasts: the results are those of the small case."""

from leadloom.llm import capping, lookalike


def test_hot_groups_without_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        data = [(i % 3, "hot" if i % 3 == 0 else f"w{i % 40}", (i * 37) % 101, i) for i in range(6000)]
        got = {r[0] for r in capping.over_cap(spark.createDataFrame(data, "grp bigint, who string, score int, id bigint"), max_count=15).collect()}
        groups = {}
        for g, w, s, i in data:
            groups.setdefault((g, w), []).append((-s, i))
        assert got == {i for v in groups.values() for _, i in sorted(v)[15:]}
        names = [(i, "カフェ" if i % 3 else "カフェ​" if i == 0 else "力フェ", "s", "c") for i in range(3000)]
        made = lookalike.alike_classes(spark.createDataFrame(names, "lead_id bigint, a string, b string, c string"), "lead_id", ["a", "b", "c"]).collect()
        assert len(made) == 3000 and {r.class_id for r in made} == {0} and {r.n_links for r in made} == {1000, 2001, 2999}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
