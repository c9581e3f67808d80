"""Aggregates: conditional counts and rates, top counters, examples, funnels, before/after gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio


def conditional_counts(df: DataFrame, named: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Number of rows for each condition, over all or by key."""
    return df.groupBy(*by).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in named.items()])


def rates(counts: DataFrame, named: dict[str, tuple[str, str]]) -> DataFrame:
    """Ratios of count columns, rounded half-even to 6 places."""
    return counts.withColumns({n: ratio(F.col(a), F.col(b)) for n, (a, b) in named.items()})


def top_counts(df: DataFrame, value: Column, seq: Column, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values, the first seen on ties: ``value, count``."""
    counted = df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("count"), F.min(seq).alias("_first"))
    return counted.orderBy(F.desc("count"), "_first").limit(n).drop("_first")


def examples(df: DataFrame, by: Sequence[str], value: Column, seq: Column, n: int) -> DataFrame:
    """The first ``n`` values of each group in order: ``by, examples``.

    Rows beyond the n-th of a group are dropped before anything is gathered.
    """
    from .rank import top_k

    kept = top_k(df.withColumns({"_value": value, "_seq": seq}), [F.col(c) for c in by], [F.col("_seq")], n)
    return kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "_value"))), lambda x: x["_value"]).alias("examples"))


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows that are left after each stage, one pass: ``stage, name, n``; a row must pass all stages before."""
    passed, counts = F.lit(True), []
    for i, (name, cond) in enumerate(stages):
        passed = passed & F.coalesce(cond, F.lit(False))
        counts.append(F.count_if(passed).alias(f"s{i}"))
    one = df.agg(*counts)
    rows = F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(n).alias("name"), F.col(f"s{i}").alias("n")) for i, (n, _) in enumerate(stages)])
    return one.select(F.inline(rows))


def exploded_counts(df: DataFrame, items: Column) -> DataFrame:
    """Number of rows for each element of an array column."""
    return df.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row with both one-row frames as structs ``before`` and ``after``."""
    a = before.select(F.struct(*before.columns).alias("before"))
    return a.crossJoin(after.select(F.struct(*after.columns).alias("after")))  # one row each


def gates(pair: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds each gate as a boolean, ``passed`` (all hold) and ``failed`` (names of those that don't)."""
    out = pair.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in checks.items()})
    everything = F.lit(True)
    for n in checks:
        everything = everything & F.col(n)
    failed = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in checks]))
    return out.withColumns({"passed": everything, "failed": failed})
