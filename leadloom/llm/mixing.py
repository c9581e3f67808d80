"""Problem 8: mixing sources to target weights by Pfair scheduling.

Sizes are tokens. The total is the largest at which every source that has documents
can give its share without using a document more than ``max_repeats`` times (or a
given total, at which small sources fall short and say so). A source's documents, in
a fixed pseudo-random order and repeated, form a stream of blocks of equal size.
Block j of a source with weight w is released in slot floor(j / w) and due at
ceil((j + 1) / w); earliest deadline first fills the slots, which keeps every source
within one block of its share at every point. With weights written as a_s / H the
schedule repeats every H slots, so only H slots are scheduled (on the driver, from
the target table alone) and every block finds its slot by arithmetic. Weights are never
rounded: where H is beyond ``MOST`` slots, the slots of the whole mixture are scheduled,
in blocks large enough that ``MOST`` slots hold it.

Offsets are running sums in two steps, of buckets and within buckets, so that a
source with a third of all documents is never sorted in one task.

Defined results: documents without source, without target or without tokens take no
part; targets without documents get no share, the others are scaled to sum to 1; no
usable target gives an empty result.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import ceil, floor, lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .bpe import count_tokens

#: The most slots that the driver schedules.
MOST = 100_000
SCHEMA = "slot bigint, source string, doc_id bigint, copy int, n_tokens bigint, source_offset bigint, target_share double, actual_share double"


def slots(weights: dict[str, Fraction], most: int = MOST) -> list[tuple[str, int]]:
    """The (source, block) of each slot of one period, or of the first ``most`` slots; weights sum to 1."""
    period = min(lcm(*(w.denominator for w in weights.values())), most)
    waiting = sorted((0, s, 0) for s in weights)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            due = ceil((j + 1) / weights[s])
            # of equal deadlines first the block whose window overlaps the next one's
            heapq.heappush(ready, (due, int((j + 1) / weights[s] == due), s, j))
        _, _, s, j = heapq.heappop(ready)
        out.append((s, j))
        heapq.heappush(waiting, (floor((j + 1) / weights[s]), s, j + 1))
    return out


def as_weights(shares: dict[str, float]) -> dict[str, Fraction]:
    """Shares as exact fractions, as they are written, that sum to 1."""
    exact = {s: Fraction(repr(v)) for s, v in shares.items()}
    total = sum(exact.values())
    return {s: v / total for s, v in exact.items()}


def mix(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 8192, buckets: int = 4096, **tokenizer: str
) -> DataFrame:
    """The mixture: one row for each use of a document, in the slot where its first token falls.

    ``documents`` has ``doc_id, source, text``, ``targets`` has ``source, target_share,
    max_repeats`` and at most some thousand rows.
    """
    spark = documents.sparkSession
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most"))
    asked = {r.source: (r.share, r.most) for r in wanted.collect()}
    sized = cut(
        count_tokens(documents.join(F.broadcast(wanted.select("source")), "source", "left_semi"), **tokenizer).where("n_tokens > 0")
        .withColumn("bucket", F.pmod(F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("n_tokens")), F.lit(buckets)).cast("int"))
    )
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("size"))
    held = {r.source: r.size for r in per_bucket.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    if not held:
        return spark.createDataFrame([], SCHEMA)
    weights = as_weights({s: asked[s][0] for s in held})
    total = total_tokens or floor(min(held[s] * asked[s][1] / weights[s] for s in held))
    period = lcm(*(w.denominator for w in weights.values()))
    if period > MOST:  # one stretch of slots for the whole mixture: each source has all its blocks in it, and a document may lie across the end
        longest = total + max(held.values())
        block_tokens = max(block_tokens, -(-longest // (MOST - len(weights))))
        period = -(-longest // block_tokens) + len(weights)
    plan = slots(weights, period)
    per = {s: sum(x == s for x, _ in plan) for s in held}
    dim = spark.createDataFrame(
        [(s, float(asked[s][0]), per[s], held[s], min(floor(total * weights[s]), held[s] * asked[s][1])) for s in held],
        "source string, target_share double, per_period bigint, held bigint, quota bigint",
    )
    where = spark.createDataFrame([(s, j, at) for at, (s, j) in enumerate(plan)], "source string, in_period bigint, at bigint")
    base = per_bucket.withColumn("base", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")).drop("size")
    inside = Window.partitionBy("source", "bucket").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        sized.withColumn("end", F.sum("n_tokens").over(inside)).join(base, ["source", "bucket"]).join(F.broadcast(dim), "source")
        .withColumn("start", F.col("base") + F.col("end") - F.col("n_tokens"))
        .withColumn("copy", F.explode(F.expr("sequence(0, cast(greatest(0, (quota - start) div held) as int))")))
        .withColumn("source_offset", F.col("copy") * F.col("held") + F.col("start"))
        # the document across the quota's end stays if that brings the size nearer to it
        .where("2 * source_offset + n_tokens <= 2 * quota and source_offset < quota")
    )
    placed = cut(
        placed.withColumn("block", F.expr(f"source_offset div {block_tokens}")).withColumn("in_period", F.expr("block % per_period"))
        .join(F.broadcast(where), ["source", "in_period"])
        .select((F.expr(f"(block div per_period) * {period}") + F.col("at")).alias("slot"), "source", "doc_id", F.col("copy").cast("int").alias("copy"), "n_tokens", "source_offset", "target_share")
    )
    got = placed.groupBy("source").agg(F.sum("n_tokens").alias("got"))
    share = got.crossJoin(got.agg(F.sum("got").alias("all"))).select("source", (F.col("got") / F.col("all")).alias("actual_share"))
    return placed.join(F.broadcast(share), "source").select(*[x.split(" ")[0] for x in SCHEMA.split(", ")])


def shares(documents: DataFrame, targets: DataFrame, **how: object) -> DataFrame:
    """Report of the mixture by source of the target table: tokens, documents, most uses of one document, target and actual share."""
    mixed = mix(documents, targets, **how)
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("n_tokens"), F.max("actual_share").alias("actual_share"))
    by = uses.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.max("uses").alias("most_uses"), F.max("actual_share").alias("actual_share")
    )
    zero = {"n_tokens": 0, "n_docs": 0, "most_uses": 0, "actual_share": 0.0}
    return targets.select("source", "target_share", "max_repeats").join(by, "source", "left").fillna(zero)
