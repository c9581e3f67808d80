"""Keep-one operators. Ties are always settled by an explicit order, so results don't depend on partitioning.

Each is one shuffle on the key; Spark keeps one row per key and task before it
(WindowGroupLimit), so a key with a large share of the rows doesn't move them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import computed


def keep_first(df: DataFrame, key: Sequence[Column], order: Sequence[Column], drop_blank: bool = False) -> DataFrame:
    """The first row of each key by ``order``; rows with a blank or null key part are dropped on request."""
    names = [f"_key{i}" for i in range(len(key))]
    out = df.withColumns(dict(zip(names, key)))
    if drop_blank:
        for n in names:
            out = out.where(F.col(n).isNotNull() & (F.col(n).cast("string") != ""))
    w = Window.partitionBy(*names).orderBy(*order)
    return out.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", *names)


def keep_best(df: DataFrame, key: Sequence[Column], score: Column, seq: Column, drop_blank: bool = False) -> DataFrame:
    """The row with the highest score of each key (null as 0), the earliest on ties."""
    return keep_first(df, key, [F.coalesce(score, F.lit(0)).desc(), seq.asc()], drop_blank)


def keep_latest(df: DataFrame, key: Sequence[Column], time: Column, seq: Column, drop_blank: bool = False) -> DataFrame:
    """The latest row of each key; unknown times count as earliest, later rows win ties."""
    return keep_first(df, key, [time.desc_nulls_last(), seq.desc()], drop_blank)


def keep_best_two_keys(df: DataFrame, first: Column, second: Column, score: Column, seq: Column) -> DataFrame:
    """Best row by the first key, for rows without it by the second; rows without either are dropped."""
    key = F.when(first != "", F.concat(F.lit("1"), first)).when(second != "", F.concat(F.lit("2"), second))
    tagged = computed(df, {"_two": key}).where("_two is not null")
    return keep_best(tagged, [F.col("_two")], score, seq).drop("_two")


def keep_position(df: DataFrame, key: Column, score: Column, seq: Column) -> DataFrame:
    """Best row of each key at the place (``position``) of the key's first row."""
    tagged = computed(df, {"_key": key}).where("_key <> ''")
    # counted and chosen apart, both with partial results, so that no key's rows meet in one task
    first = tagged.groupBy("_key").agg(F.min(seq).alias("position"))
    return keep_best(tagged, [F.col("_key")], score, seq).join(first, "_key").drop("_key")


def smallest_raw(df: DataFrame, key: Column, raw: Column) -> DataFrame:
    """Smallest spelling of each key and the number of spellings: ``key, raw, n``."""
    return df.groupBy(key.alias("key")).agg(F.min(raw).alias("raw"), F.count_distinct(raw).alias("n"))


def merge_nonblank(df: DataFrame, key: str, columns: Sequence[str], seq: str) -> DataFrame:
    """One row per key: of each column the last non-blank value."""
    last = [F.max_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(seq))).alias(c) for c in columns]
    return df.groupBy(key).agg(*last)
