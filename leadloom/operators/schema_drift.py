"""Problem 1: files whose fields are added, renamed, removed or change type.

Schemas are inferred as tagged unions: per file each field carries the set of JSON
types of its values, and a feed's schema is the fusion of its files' schemas with
every alternative kept. Values of a field with several types are split into typed
branches and also brought to one canonical text, in which 12, 12.0, "１２" and "12点"
or a time and its epoch second are equal. A rename is found where a field that goes
and one that comes hold the same canonical values for the leads in both files, more
often than their value distributions would by chance.

Defined results: payloads that aren't JSON objects have no fields; keys count as
spelled; a field without non-null values has no type, so it is never retyped; files
with equal ``snapshot_day`` follow ``delivered_at``, then ``file_id``; of repeated rows
of a lead the last line holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.urls import let
from ..session import cut, small

#: Words for yes and no.
YES, NO = ["true", "あり", "有", "○", "◯", "yes", "はい"], ["false", "なし", "無", "×", "✕", "no", "いいえ"]
KEY = "lead_id"


def kind(value: Column) -> Column:
    """JSON type of a variant: integer, decimal, string, boolean, array, object; null for null."""
    return let(F.schema_of_variant(value), lambda name: (
        F.when(name == "STRING", "string").when(name == "BIGINT", "integer").when(name == "VOID", None).when(name == "BOOLEAN", "boolean")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object")
        # whole numbers are BIGINT up to 18 digits; a shorter DECIMAL(n,0) was written with a decimal point
        .when(name.rlike(r"^DECIMAL\((19|[2-9]\d),0\)"), "integer").otherwise("decimal")
    ))


DAY = r"^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?[T ]?\s*(\d{1,2})[:時](\d{1,2})[:分](\d{1,2})(?:\.\d+)?秒?(?:Z|\+00:?00)?$"
NUMBER = r"^[+-]?\d+(?:\.\d+)?(?:点|%|件|位)?$"
PHONE = r"^\+?[0-9(][0-9()\-‐–－ ]{6,}[0-9]$"


def canonical(text: Column, of: Column) -> Column:
    """One text for equal values of different types; ``text`` is the value as text (arrays as JSON), ``of`` its type."""
    narrow = F.regexp_replace(F.translate(text, "０１２３４５６７８９．－＋，", "0123456789.-+,"), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")

    def second(plain: Column) -> Column:
        part = lambda n: F.regexp_extract(plain, DAY, n).cast("int")
        days = F.datediff(F.make_date(part(1), part(2), part(3)), F.lit("1970-01-01").cast("date")).cast("bigint")
        return (days * 86400 + part(4) * 3600 + part(5) * 60 + part(6)).cast("string")

    def number(plain: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(plain, r"^\+|(?:点|%|件|位)$", ""), r"^(-?)0+(?=\d)", "$1")
        short = F.when(F.contains(bare, F.lit(".")), F.regexp_replace(bare, r"\.?0+$", "")).otherwise(bare)
        return let(short, lambda v: F.when(v == "-0", "0").otherwise(v))

    def scalar(plain: Column) -> Column:
        low = F.lower(plain)
        return (
            F.when(~plain.rlike(r"^[+\-(]?\d"), F.when(low.isin(YES), "1").when(low.isin(NO), "0").otherwise(F.regexp_replace(plain, r"(?U)\s*[,;|、；，]\s*", "|")))
            .when(plain.rlike(NUMBER), number(plain)).when(plain.rlike(DAY), second(plain))
            .when(plain.rlike(PHONE), F.regexp_replace(F.regexp_replace(plain, r"[^0-9]", ""), r"^0+(?=\d)", "")).otherwise(F.regexp_replace(plain, r"(?U)\s*[,;|、；，]\s*", "|"))
        )

    listed = F.regexp_replace(F.array_join(F.from_json(narrow, "array<string>"), "|"), r"(?U)\s+", " ")
    return F.when(of == "array", listed).otherwise(let(narrow, scalar))


def entries(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each key of each payload: ``row_id, file_id, line_no, lead_id, key, kind, value`` and the columns to ``keep``."""
    spark = rows.sparkSession
    parsed = rows.select("row_id", "file_id", "line_no", *keep, F.try_parse_json("payload").alias("v"))
    parsed = parsed.where(F.schema_of_variant("v").startswith("OBJECT")).withColumn("lead_id", F.try_variant_get("v", f"$.{KEY}", "string"))
    out = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return out.where(F.col("key") != KEY).select("row_id", "file_id", "line_no", "lead_id", *keep, "key", kind(F.col("value")).alias("kind"), "value")


def as_text(value: Column, of: Column) -> Column:
    return F.when(of.isin("array", "object"), F.to_json(value)).otherwise(value.cast("string"))


def file_order(files: DataFrame) -> DataFrame:
    """``file_id`` with its feed, place in the feed and the file before it."""
    order = Window.partitionBy("feed").orderBy("snapshot_day", "delivered_at", "file_id")
    return files.select("file_id", "feed", "snapshot_day", F.row_number().over(order).alias("seq"), F.lag("file_id").over(order).alias("before_id"))


def file_schemas(rows: DataFrame) -> DataFrame:
    """The tagged union of each file: ``file_id, field, kinds`` (sorted, empty if all values are null)."""
    return entries(rows).groupBy("file_id", F.col("key").alias("field")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def renames(rows: DataFrame, gone: DataFrame, come: DataFrame, least: float = 0.7, beyond_chance: float = 0.6) -> DataFrame:
    """``file_id, old_field, new_field`` of the fields that carry on under another name.

    ``gone`` and ``come`` hold ``file_id, before_id, field``. The share of equal values is at
    least ``least``, and of what chance leaves open at least ``beyond_chance``. Best pairs
    are taken first, each field once; ties go by more leads, then by the old and the new name.
    """
    both = gone.select("file_id").distinct().join(come.select("file_id").distinct(), "file_id")
    role = lambda side, at, n: side.join(both, "file_id", "left_semi").select(F.col(at).alias("from_file"), F.struct(F.col("file_id").alias("in_file"), F.lit(n).alias("role"), "field").alias("want"))
    # what each file is asked for: a few fields; rows of other files are never parsed, other fields never canonicalised
    asked = role(gone, "before_id", 0).unionAll(role(come, "file_id", 1)).groupBy("from_file").agg(F.collect_list("want").alias("wants"))
    needed = rows.select("row_id", "file_id", "line_no", "payload").join(asked, F.col("file_id") == F.col("from_file"))
    seen = entries(needed, ["wants"]).where("kind is not null and lead_id is not null")
    seen = seen.select("line_no", "lead_id", "kind", "value", F.inline(F.filter("wants", lambda w: w["field"] == F.col("key"))))
    text = canonical(as_text(F.col("value"), F.col("kind")), F.col("kind"))
    last = seen.groupBy("in_file", "role", "lead_id", "field").agg(F.max_by(text, F.col("line_no")).alias("text"))
    side = lambda n, name: last.where(F.col("role") == n).select("in_file", "lead_id", F.col("field").alias(f"{name}_field"), F.col("text").alias(name))
    pairs = side(0, "old").join(side(1, "new"), ["in_file", "lead_id"])
    counted = pairs.groupBy("in_file", "old_field", "new_field", "old", "new").agg(F.count("*").alias("n"))
    group = ["in_file", "old_field", "new_field"]
    # per value its number on either side: sum(a * b) / total^2 is how often chance alone would make the sides agree
    n, none = F.col("n"), F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("old").alias("v"), n.alias("a"), none.alias("b"), F.when(F.col("old") == F.col("new"), n).otherwise(none).alias("equal")),
        F.struct(F.col("new").alias("v"), none.alias("a"), n.alias("b"), none.alias("equal")),
    )
    each = counted.select(*group, F.inline(sides)).groupBy(*group, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("equal").alias("equal"))
    scored = each.groupBy(*group).agg((F.sum("equal") / F.sum("a")).alias("share"), (F.sum(F.col("a") * F.col("b")) / F.sum("a") / F.sum("a")).alias("chance"), F.sum("a").alias("total"))
    scored = scored.withColumn("score", F.when(F.col("chance") >= 1, F.lit(0.5)).otherwise((F.col("share") - F.col("chance")) / (1 - F.col("chance"))))
    good = scored.where((F.col("share") >= least) & ((F.col("score") >= beyond_chance) | (F.col("chance") >= 1)))

    # the pairs of one file that agree are few: best first, each field once
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), (-F.col("total")).alias("b"), "old_field", "new_field")))
    start = F.array().cast("array<struct<old_field:string,new_field:string>>")
    free = lambda held, x: ~F.exists(held, lambda h: (h["old_field"] == x["old_field"]) | (h["new_field"] == x["new_field"]))
    taken = F.aggregate(order, start, lambda held, x: F.when(free(held, x), F.concat(held, F.array(F.struct(x["old_field"].alias("old_field"), x["new_field"].alias("new_field"))))).otherwise(held))
    return good.groupBy(F.col("in_file").alias("file_id")).agg(taken.alias("taken")).select("file_id", F.inline("taken"))


@dataclass
class Compared:
    """The files of all feeds compared with the files before them, each part computed once.

    ``order`` (file_order), ``schemas`` (file_schemas), ``both`` (fields of a file and of the file
    before it with their types ``now`` and ``was``) and ``moved`` (renames). Schemas and renames
    are few beside the rows and are cut: payloads are parsed once for them, those of files with
    fields that go and come once more for renames, whatever is derived from them.
    """

    order: DataFrame
    schemas: DataFrame
    both: DataFrame
    moved: DataFrame


def compared(files: DataFrame, rows: DataFrame) -> Compared:
    every = file_order(files)
    order = every.where("before_id is not null").select("file_id", "before_id")
    schemas = cut(file_schemas(rows))
    now = order.join(schemas, "file_id").select("file_id", "before_id", "field", F.col("kinds").alias("now"))
    was = order.join(schemas.withColumnRenamed("file_id", "before_id"), "before_id").select("file_id", "before_id", "field", F.col("kinds").alias("was"))
    both = cut(now.join(was, ["file_id", "before_id", "field"], "full"))
    gone, come = both.where("now is null"), both.where("was is null")
    moved = cut(renames(rows, gone.select("file_id", "before_id", "field"), come.select("file_id", "before_id", "field")))
    return Compared(every, schemas, both, moved)


def changes(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Every change of a file against the file before it in its feed: ``file_id, change, old_field, new_field``."""
    c = compared(files, rows)
    both, moved, gone, come = c.both, c.moved, c.both.where("now is null"), c.both.where("was is null")
    old, new = moved.select("file_id", F.col("old_field").alias("field")), moved.select("file_id", F.col("new_field").alias("field"))
    row = lambda change, a, b: [F.col("file_id"), F.lit(change).alias("change"), a.alias("old_field"), b.alias("new_field")]
    field, none = F.col("field"), F.lit("")
    typed = lambda d: d.where("size(was) > 0 and size(now) > 0 and was <> now")
    moved_types = (
        moved.join(gone.select("file_id", F.col("field").alias("old_field"), "was"), ["file_id", "old_field"])
        .join(come.select("file_id", F.col("field").alias("new_field"), "now"), ["file_id", "new_field"])
    )
    return (
        come.join(new, ["file_id", "field"], "left_anti").select(*row("added", none, field))
        .unionAll(gone.join(old, ["file_id", "field"], "left_anti").select(*row("removed", field, none)))
        .unionAll(moved.select(*row("renamed", F.col("old_field"), F.col("new_field"))))
        .unionAll(typed(both).select(*row("retyped", field, field)))
        .unionAll(typed(moved_types).select(*row("retyped", F.col("old_field"), F.col("new_field"))))
    )


def lineage(c: Compared) -> DataFrame:
    """``file_id, feed, field, name``: the name under which a field first appeared in its feed, followed through its renames.

    A field's files in a feed fall into stretches, a new one wherever a rename leads to it. Renames
    link stretches; their chains are followed by doubling, so their number of joins is the logarithm
    of the longest chain, and no feed is gathered.
    """
    into = c.moved.select("file_id", F.col("new_field").alias("field"), "old_field")
    order = Window.partitionBy("feed", "field").orderBy("seq")
    held = c.order.select("feed", "seq", "file_id", "before_id").join(c.schemas.select("file_id", "field"), "file_id").join(into, ["file_id", "field"], "left")
    held = cut(held.withColumn("part", F.count("old_field").over(order)))
    before = held.select(F.col("file_id").alias("before_id"), F.col("field").alias("old_field"), F.struct("feed", "field", "part").alias("parent"))
    links = held.where("old_field is not null").join(before, ["before_id", "old_field"]).select(F.struct("feed", "field", "part").alias("child"), "parent")
    links = cut(links)
    while True:
        nexts = links.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        further = cut(links.join(nexts, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("went")))
        links = further.select("child", "parent")
        if further.where("went").isEmpty():
            break
    named = held.withColumn("child", F.struct("feed", "field", "part")).join(links, "child", "left")
    return named.select("file_id", "feed", "field", F.coalesce("parent.field", "field").alias("name"))


def consistent_table(files: DataFrame, rows: DataFrame) -> DataFrame:
    """The one consistent lead table: each value under the lasting name of its field, in its typed branch and in canonical form."""
    # names are a few for each file: where they are counted to be few, values need no shuffle to meet them
    names = small(cut(lineage(compared(files, rows))))
    seen = entries(rows).where("kind is not null").withColumnRenamed("key", "field").join(names, ["file_id", "field"])
    text = as_text(F.col("value"), F.col("kind"))
    get = lambda of, to: F.when(F.col("kind") == of, F.try_variant_get("value", "$", to))
    return seen.select(
        "row_id", "file_id", "feed", "lead_id", "name", "kind", get("integer", "bigint").alias("as_integer"), get("decimal", "double").alias("as_decimal"),
        F.when(F.col("kind") == "string", text).alias("as_string"), get("boolean", "boolean").alias("as_boolean"), get("array", "array<string>").alias("as_array"),
        canonical(text, F.col("kind")).alias("canonical"),
    )


def alternatives(files: DataFrame, rows: DataFrame) -> DataFrame:
    """The fused schema: each type of each lasting field, with the file in which it first appears and the number of its files."""
    c = compared(files, rows)
    typed = lineage(c).join(c.schemas, ["file_id", "field"]).join(c.order.select("file_id", "seq"), "file_id")
    each = typed.select("feed", "name", "file_id", "seq", F.explode("kinds").alias("kind"))
    # a field is in a file once, so counting rows counts files, unless two fields of a file share a lasting name
    return each.groupBy("feed", "name", "kind").agg(F.min_by("file_id", "seq").alias("first_file_id"), F.count_distinct("file_id").alias("n_files"))
