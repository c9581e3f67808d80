"""Lookups and semi-joins of leads with rule, feedback and ledger tables.

Sides are broadcast only by Spark's own size check (autoBroadcastJoinThreshold, AQE);
nothing here forces a broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import suffixes
from .rank import top_k


def fallback_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], name: str) -> DataFrame:
    """Left join by the first pair of key columns, for rows without a partner by the next; the partner is a struct ``name`` that never mixes rows.

    The right side must have one row for each value of each key.
    """
    out = left
    for i, (lk, rk) in enumerate(keys):
        side = right.where(F.col(rk).isNotNull()).select(F.col(rk).alias(f"_k{i}"), F.struct(*right.columns).alias(f"_r{i}"))
        out = out.join(side, F.col(lk) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    parts = [f"_r{i}" for i in range(len(keys))]
    return out.withColumn(name, F.coalesce(*parts)).drop(*parts)


def suffix_semi(left: DataFrame, domain: Column, listed: DataFrame, column: str, anti: bool = False) -> DataFrame:
    """Rows whose domain is listed or lies under a listed one (or, with ``anti``, the others), by an equi-join on exploded suffixes."""
    keyed = left.withColumn("_domain", domain)
    # each domain is looked up once, however many rows it has
    domains = keyed.select("_domain").where("_domain is not null").distinct()
    wanted = listed.select(F.col(column).alias("_s")).distinct()
    hits = domains.select("_domain", F.explode(suffixes(F.col("_domain"))).alias("_s")).join(wanted, "_s", "left_semi").select("_domain").distinct()
    return keyed.join(hits, "_domain", "left_anti" if anti else "left_semi").drop("_domain")


def marked_by_suffix(left: DataFrame, key: str, domain: Column, listed: DataFrame, column: str) -> DataFrame:
    """``key`` and the longest listed domain that its domain equals or lies under."""
    each = left.select(key, F.posexplode(suffixes(domain)).alias("_at", "_s"))
    hits = each.join(listed.select(F.col(column).alias("_s")).distinct(), "_s")
    return hits.groupBy(key).agg(F.min_by("_s", "_at").alias("listed"))


def either_way_suffix(left: DataFrame, right: DataFrame, left_key: str, left_domain: str, right_key: str, right_domain: str) -> DataFrame:
    """Pairs of rows whose domains are equal or one lies under the other: two equi-joins on exploded suffixes."""
    a, b = left.select(left_key, left_domain), right.select(right_key, right_domain)
    down = a.select("*", F.explode(suffixes(F.col(left_domain))).alias("_s")).join(b, F.col("_s") == F.col(right_domain))
    up = b.select("*", F.explode(suffixes(F.col(right_domain))).alias("_s")).join(a, F.col("_s") == F.col(left_domain))
    return down.select(left_key, right_key).unionByName(up.select(left_key, right_key)).distinct()


def unseen(df: DataFrame, key: Column, existing: DataFrame, existing_key: Column) -> DataFrame:
    """Rows whose key isn't among the existing ones; null and blank keys count as unseen."""
    seen = existing.select(existing_key.alias("_seen")).where("_seen <> ''").distinct()
    return df.withColumn("_key", key).join(seen, F.col("_key") == F.col("_seen"), "left_anti").drop("_key")


def first_sources(df: DataFrame, key: str, value: str, seq: str, most: int = 3) -> DataFrame:
    """First value and the first ``most`` different values of each key, in order of first appearance."""
    firsts = df.groupBy(key, value).agg(F.min(seq).alias("_at"))
    kept = top_k(firsts, [F.col(key)], [F.col("_at"), F.col(value)], most, "_rank")  # no more than these are gathered
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_rank", value))), lambda x: x[value])
    return kept.groupBy(key).agg(F.min_by(value, "_rank").alias("first_value"), ordered.alias("values"))
