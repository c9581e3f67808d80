"""Problem 2: records that differ only in formatting, collapsed by bottom-up hashing.

Leaves are normalised (white space, punctuation of any script and letter case go),
each gets a digest; the entries of ``attrs`` and the query parameters of ``url`` are
unordered nodes, whose child digests are sorted before they are hashed; fields are
ordered nodes. Rows are grouped by the root digest, and the canonical structure
itself is part of the grouping key, so that a digest collision can't merge two
records. The aggregation combines on the map side: a record with a third of all
lines sends one row per task.

Defined results: null agrees with null only, and is not the empty text; an entry
without a colon continues the value before it (or, as the first, has an empty
name); repeated entries count as often as they stand there; a null identifier is
ignored in the smallest one but counted as a copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates entries of ``attrs``.
ENTRY = r"[;；,，、/／|｜\n]"


def leaf(c: Column) -> Column:
    """Text without white space, control characters and punctuation, in lower case; null stays null."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s\p{P}\p{Cc}\p{Cf}]+", ""))


def digest(*parts: Column) -> Column:
    """Digest of an ordered node; a null part differs from every text."""
    return F.md5(F.concat_ws("", *[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("~")) for p in parts]))


def unordered(children: Column) -> Column:
    """Digest of a node whose children have no order, but each counts."""
    return F.md5(F.array_join(F.array_sort(children), ""))


def entries(attrs: Column) -> Column:
    """The normalised ``name``/``value`` pairs of an attribute text."""
    marked = F.regexp_replace(attrs, ENTRY + r"(?=[^:：;；,，、/／|｜\n]*[:：])", "\u0001")
    part = F.filter(F.split(marked, "\u0001"), lambda x: leaf(x) != "")
    return F.transform(
        part,
        lambda x: F.struct(
            leaf(F.regexp_extract(x, r"(?s)^([^:：]*)[:：]", 1)).alias("name"), leaf(F.regexp_replace(x, r"(?s)^[^:：]*[:：]", "")).alias("value")
        ),
    )


def canonical(rows: DataFrame) -> DataFrame:
    """``id`` and the canonical structure of each record of ``id, url, store_name, city, attrs``."""
    url = F.regexp_replace("url", r"(?U)^\s+|\s+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    parts = F.transform(
        F.filter(F.split(query, "&"), lambda x: leaf(x) != ""),
        lambda x: F.struct(leaf(F.regexp_extract(x, r"(?s)^([^=]*)", 1)).alias("name"), leaf(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1)).alias("value")),
    )
    return rows.select(
        F.col("id"),
        F.when(F.col("url").isNotNull(), F.struct(
            leaf(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)).alias("scheme"),
            leaf(F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"(?s)[?#].*$", "")).alias("base"),
            F.array_sort(parts).alias("query"),
            leaf(F.regexp_extract(url, r"(?s)#(.*)$", 1)).alias("fragment"),
        )).alias("url"),
        leaf(F.col("store_name")).alias("store_name"),
        leaf(F.col("city")).alias("city"),
        F.when(F.col("attrs").isNotNull(), F.array_sort(entries(F.col("attrs")))).alias("attrs"),
    )


def with_root(rows: DataFrame) -> DataFrame:
    """Adds ``root``, the digest built bottom-up over the canonical structure."""
    pair = lambda x: digest(x["name"], x["value"])
    url = F.when(
        F.col("url").isNotNull(), digest(F.col("url.scheme"), F.col("url.base"), unordered(F.transform("url.query", pair)), F.col("url.fragment"))
    )
    attrs = F.when(F.col("attrs").isNotNull(), unordered(F.transform("attrs", pair)))
    return rows.withColumn("root", digest(url, F.col("store_name"), F.col("city"), attrs))


def collapse(rows: DataFrame) -> DataFrame:
    """One row per record: smallest ``id`` and number of ``copies``."""
    kept = with_root(canonical(rows))
    whole = F.to_json(F.struct("url", "store_name", "city", "attrs"))
    return kept.select("id", "root", whole.alias("whole")).groupBy("root", "whole").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).drop("whole", "root")
