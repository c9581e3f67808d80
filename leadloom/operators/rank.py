"""Ranking, top-k, ratios, gap filling, identifiers and streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, key: Sequence[Column], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key by ``order``, with their rank."""
    names = [f"_key{i}" for i in range(len(key))]
    w = Window.partitionBy(*names).orderBy(*order)
    return df.withColumns(dict(zip(names, key))).withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).drop(*names)


def top_share(df: DataFrame, key: Sequence[str], order: Sequence[Column], share: float) -> DataFrame:
    """The first ``floor(n * share)`` rows (at least one) of each key by ``order``, with their rank; null keys are keys.

    ``key`` and ``order`` must order all rows (ties make the choice arbitrary). Ranks come from one global range
    sort, so a key that holds most rows is spread over many tasks.
    """
    placed = positions(df, [*[F.col(k).asc_nulls_first() for k in key], *order], "_at")
    size = placed.groupBy(*key).agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    names = {k: f"_of_{i}" for i, k in enumerate(key)}
    same = F.lit(True)
    for k, n in names.items():
        same = same & placed[k].eqNullSafe(F.col(n))
    ranked = placed.join(size.withColumnsRenamed(names), same).withColumn("rank", (F.col("_at") - F.col("_low") + 1).cast("int"))
    return ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))).drop("_n", "_low", "_at", *names.values())


def label_order(label: Column) -> Column:
    """Place of a sales label: ○ 2, △ 1, others 0."""
    return F.when(label == "○", 2).when(label == "△", 1).otherwise(0).cast("int")


def rescue(kept: DataFrame, spare: DataFrame, key: Sequence[str], order: Sequence[Column], least: int, most: int) -> DataFrame:
    """Spare rows that fill each key up to ``least`` kept rows, at most ``most`` of them."""
    held = kept.groupBy(*key).agg(F.count("*").alias("_held"))
    ranked = top_k(spare, [F.col(k) for k in key], order, most)  # the fixed limit first: Spark drops the others before the shuffle
    need = F.least(F.lit(least) - F.coalesce("_held", F.lit(0)), F.lit(most))
    return ranked.join(held, list(key), "left").where(F.col("rank") <= need).drop("_held")


def positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Global position 1, 2, ... by ``order`` without a single-task sort: a range sort, counts per partition, and positions within partitions."""
    ordered = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_within", F.monotonically_increasing_id())
    from ..session import cut

    fixed = cut(ordered)
    counts = fixed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_within").alias("_low"))
    base = counts.withColumn("_base", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_base", "_low")
    placed = fixed.join(F.broadcast(base), "_part")  # one row for each partition
    return placed.withColumn(name, F.col("_base") + F.col("_within") - F.col("_low") + 1).drop("_part", "_within", "_base", "_low")


def next_ids(df: DataFrame, existing: DataFrame, id_column: str, order: Sequence[Column], start: int, width: int = 5) -> DataFrame:
    """New zero-padded identifiers after the largest existing number (or ``start``), in order."""
    top = existing.agg(F.coalesce(F.max(F.col(id_column).try_cast("bigint")), F.lit(start - 1)).alias("_top"))
    numbered = positions(df, order, "_n").crossJoin(F.broadcast(top))  # one row
    full = (F.col("_top") + F.col("_n")).cast("string")
    return numbered.withColumn("new_id", F.when(F.length(full) < width, F.lpad(full, width, "0")).otherwise(full)).drop("_n", "_top")


def streaks(df: DataFrame, key: Sequence[str], order: Sequence[Column], flag: Column) -> DataFrame:
    """Runs of rows with the flag: ``key, first_at, length`` (gaps and islands)."""
    w = Window.partitionBy(*key).orderBy(*order)
    tagged = df.withColumn("_flag", flag).withColumn("_rank", F.row_number().over(w))
    island = F.col("_rank") - F.row_number().over(Window.partitionBy(*key, "_flag").orderBy(*order))
    return tagged.withColumn("_island", island).where("_flag").groupBy(*key, "_island").agg(F.min("_rank").alias("first_at"), F.count("*").alias("length")).drop("_island")
