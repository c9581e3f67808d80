"""Sinks: quoted CSV with labels, tiered folders, text and JSON forms, idempotent appends.

Files are written by the executors in parallel; only reports of fixed size are written
by the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalize_sheet, strip
from ..operators.dedupe import keep_first
from ..operators.joins import unseen
from .files import listed

BOM = "﻿"


def as_text(df: DataFrame, separator: str = "; ") -> DataFrame:
    """All columns as text: arrays joined, null as ''."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        c = F.array_join(c.cast("array<string>"), separator) if kind.startswith("array") else F.to_json(c) if kind.startswith(("struct", "map")) else c.cast("string")
        out.append(F.coalesce(c, F.lit("")).alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, labels: dict[str, str] | None = None, columns: Sequence[str] = (), bom: bool = True) -> None:
    """Fully quoted CSV with the given column order and labels; the header of every part starts with a BOM for spreadsheet programs."""
    out = as_text(df.select(*(columns or df.columns)))
    names = [(labels or {}).get(c, c) for c in out.columns]
    names[0] = BOM + names[0] if bom else names[0]
    out.toDF(*names).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_tiers(df: DataFrame, path: str, tier: str) -> None:
    """One folder for each value of ``tier``."""
    as_text(df).repartition(tier).write.mode("overwrite").partitionBy(tier).option("header", True).option("quoteAll", True).csv(path)


def three_lines(name: Column, url: Column, comment: Column) -> Column:
    """Name, address and comment of a lead on three lines."""
    return F.concat_ws("\n", F.coalesce(name, F.lit("")), F.coalesce(url, F.lit("")), F.concat(F.lit("△ "), F.coalesce(comment, F.lit(""))))


def result_json(df: DataFrame, reasons: str, most: int = 5) -> DataFrame:
    """Rows as JSON text with at most ``most`` reasons: ``json``."""
    return df.withColumn(reasons, F.slice(reasons, 1, most)).select(F.to_json(F.struct(*df.columns)).alias("json"))


def sheet_key(df: DataFrame, url: str = "url") -> Column:
    """Key of a row in an append: its normalised address, or for a blank one the digest of the whole row."""
    u = strip(F.coalesce(F.col(f"`{url}`"), F.lit("")))
    whole = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    return F.when(u != "", normalize_sheet(u)).otherwise(F.concat(F.lit("row:"), whole))


def new_rows(df: DataFrame, existing: DataFrame | None, url: str = "url") -> DataFrame:
    """One row for each key that ``existing`` doesn't hold: of several the first by its values."""
    once = keep_first(df, [sheet_key(df, url)], [F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))])
    if existing is None:
        return once
    same = existing.select(*[F.col(f"`{c}`") if c in existing.columns else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
    return unseen(once, sheet_key(once, url), same, sheet_key(same, url))


def append_unseen(df: DataFrame, path: str, url: str = "url") -> None:
    """Appends the rows whose normalised address a Parquet table doesn't hold, one of each address; repeating it adds nothing.

    Rows without an address are told apart by all their values. ``path`` may lie in any Hadoop file system.
    """
    spark = df.sparkSession
    new_rows(df, spark.read.parquet(path) if listed(spark, path) else None, url).write.mode("append").parquet(path)


def write_lines(df: DataFrame, path: str, column: str = "url") -> None:
    """One value on each line, blank ones left out: lists of failed or dead addresses."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null and value <> ''").write.mode("overwrite").text(path)


def with_schema(df: DataFrame, schema: Sequence[str], drop_others: bool = True) -> DataFrame:
    """The columns of ``schema`` in its order, missing ones as ''; others follow unless they are dropped."""
    kept = [F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in schema]
    return df.select(*kept, *([] if drop_others else [F.col(f"`{c}`") for c in df.columns if c not in schema]))


def run_meta(df: DataFrame, counted: dict[str, Column], domain: str = "domain", query: str = "query", most: int = 10) -> DataFrame:
    """One row that describes a run: counts of conditions, a digest of the different queries, the most frequent domains.

    Queries are digested one by one and their digests summed, so no list of all is gathered; equal
    sets of queries have equal digests in any order.
    """
    from ..operators.aggregate import conditional_counts, top_counts

    counts = conditional_counts(df, counted)
    words = df.select(F.col(query).alias("q")).where("q is not null").distinct()
    digest = words.agg(F.count("*").alias("n_queries"), F.sum(F.conv(F.substring(F.sha2("q", 256), 1, 12), 16, 10).cast("decimal(38,0)")).alias("s"))
    digest = digest.select("n_queries", F.substring(F.sha2(F.concat_ws(":", "n_queries", F.coalesce("s", F.lit(0))), 256), 1, 16).alias("query_hash"))
    top = top_counts(df, F.col(domain), F.col(domain), most).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "value"))), lambda x: x["value"]).alias("top_domains"))
    return counts.crossJoin(digest).crossJoin(top)  # one row each


def markdown(title: str, values: dict[str, object]) -> str:
    """A report block that ``read_summaries`` reads back."""
    return "\n".join([f"## {title}", *[f"- {k}: {v}" for k, v in values.items()]]) + "\n"


def write_report(one_row: DataFrame, path: str, required: Sequence[str] = ()) -> dict:
    """One-row result as a JSON document; raises ValueError where a required field is missing."""
    doc = json.loads(one_row.select(F.to_json(F.struct(*one_row.columns), {"ignoreNullFields": "false"}).alias("j")).first().j)
    missing = [r for r in required if r not in doc]
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False, indent=2, sort_keys=True)
    return doc
