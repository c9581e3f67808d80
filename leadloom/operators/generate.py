"""Query generation: templates over dimensions, limits per pair, negative and required words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def expand(dims: DataFrame, templates: Sequence[str], limit: int | None = None, key: Sequence[str] = ()) -> DataFrame:
    """A query for each row of ``dims`` and each template, whose ``{column}`` marks are filled: ``..., ord, query``.

    ``limit`` keeps the first queries for each ``key``; equal queries (white space aside) are kept once per key.
    """
    def filled(t: str) -> Column:
        out = F.lit(t)
        for c in dims.columns:
            if f"{{{c}}}" in t:
                out = F.replace(out, F.lit(f"{{{c}}}"), F.col(c).cast("string"))
        return F.regexp_replace(F.trim(out), r"(?U)\s+", " ")

    each = dims.select("*", F.posexplode(F.array(*[filled(t) for t in templates])).alias("ord", "query"))
    group = list(key) or list(dims.columns)
    once = each.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "query").orderBy("ord"))).where("_n = 1 and query <> ''").drop("_n")
    if limit is None:
        return once
    return once.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy("ord"))).where(F.col("_n") <= limit).drop("_n")


def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of two dimension tables, which don't grow with the data."""
    return left.crossJoin(right)


def allowed(query: Column, negatives: Sequence[str], required: Sequence[Sequence[str]] = ()) -> Column:
    """No negative word (a word after '-' excludes it and isn't one), and of each group of required words at least one."""
    low = F.concat(F.lit(" "), F.lower(query), F.lit(" "))
    # the excluded words of the query itself don't count
    low = F.regexp_replace(low, r"(?<=\s)-\S+", "")
    out = F.lit(True)
    for w in negatives:
        out = out & ~F.contains(low, F.lit(w.lower()))
    for group in required:
        any_of = F.lit(False)
        for w in group:
            any_of = any_of | F.contains(low, F.lit(w.lower()))
        out = out & any_of
    return out


def passes(pairs_df: DataFrame, hits: DataFrame, key: Sequence[str], least: int, limits: Sequence[int], most: int | None = None) -> DataFrame:
    """Which pass still asks for each pair: ``..., pass, n_queries``, out of recorded ``hits`` with their ``pass``.

    Pass p (from 1) is due for a pair with fewer than ``least`` different addresses from the passes before it, and asks at
    most ``limits[p - 1]`` queries; with ``most``, later ones in the order of pass and pair are dropped beyond that many queries.
    """
    n = len(limits)
    seen = hits.groupBy(*key, "url").agg(F.min("pass").alias("first")).groupBy(*key).agg(*[F.count_if(F.col("first") < p).alias(f"_before_{p}") for p in range(1, n + 1)])
    due = F.array(*[F.when(F.coalesce(F.col(f"_before_{p}"), F.lit(0)) < least, F.struct(F.lit(p).alias("pass"), F.lit(limits[p - 1]).alias("n_queries"))) for p in range(1, n + 1)])
    out = pairs_df.join(seen, list(key), "left").select(*pairs_df.columns, F.inline(F.array_compact(due)))
    if most is None:
        return out
    from .rank import positions

    ordered = positions(out, [F.col("pass"), *map(F.col, key)], "_at")
    # queries before a pair: those of whole passes and those of its own pass, all of one size
    per = ordered.groupBy("pass").agg(F.sum("n_queries").alias("_all"), F.min("_at").alias("_low"))
    base = per.select("pass", "_low", (F.sum("_all").over(Window.orderBy("pass")) - F.col("_all")).alias("_base"))  # one row for each pass
    return ordered.join(base, "pass").where(F.col("_base") + (F.col("_at") - F.col("_low") + 1) * F.col("n_queries") <= most).select(*out.columns)


def starved(pairs_df: DataFrame, hits: DataFrame, key: Sequence[str], least: int) -> DataFrame:
    """Pairs with fewer than ``least`` different hits, for the next pass, with their number."""
    n = hits.groupBy(*key).agg(F.count_distinct("url").alias("n_urls"))
    return pairs_df.join(n, list(key), "left").fillna({"n_urls": 0}).where(F.col("n_urls") < least)
