"""Problem 5: capping the records of dominant contributors by radix selection.

The order "best score first, then smallest identifier" is encoded as bytes that
compare in the same order: eight for the score, any number, eight for the identifier.
Contributors beyond their cap are found by counts; their rows are counted by the value
of the first byte in which they differ, the value at which the cap is reached is fixed,
and only rows that share the fixed bytes with the cutoff go on to the next byte that
differs. No contributor's rows are ever gathered or sorted; what is shuffled by
contributor are counts that were combined on the map side.

Defined results: a null or NaN score counts as 0; equal scores of any type tie, decimals
as doubles; a contributor that can't be read (null, blank) is never capped; a null
identifier sorts last; repeated rows each count, and of equal keys as many copies are
dropped as exceed the cap. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

#: Keys are signed; flipping the sign bit lets their bytes compare unsigned.
SIGN = "(-9223372036854775807L - 1L)"
LAST = 2**63 - 1


def host_of(domain: Column, url: Column) -> Column:
    """The contributor: host of ``domain``, or of ``url`` where domain is null or blank; null if neither has one."""

    def clean(c: Column) -> Column:
        c = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
        c = F.regexp_replace(c, r"^(?:[a-z][a-z0-9+.\-]*:)?//", "")
        c = F.regexp_replace(c, r"[/?#\\].*$", "")
        c = F.regexp_replace(c, r"^.*@", "")
        c = F.regexp_replace(c, r"(?U)\s*:\d*$", "")
        return F.regexp_replace(F.regexp_replace(c, r"\.$", ""), r"^www\.", "")

    filled = lambda c: F.when(clean(c) != "", clean(c))
    blank = F.coalesce(F.regexp_replace(domain, r"(?U)\s+", "") == "", F.lit(True))
    return F.when(blank, filled(url)).otherwise(filled(domain))


def ordered(score: Column, kind: str) -> Column:
    """A bigint that compares like a number; null and NaN like 0. A double becomes its IEEE bits, made of exponent and mantissa."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(score.cast("bigint"), F.lit(0).cast("bigint"))
    x = F.coalesce(F.nanvl(score.cast("double"), F.lit(0.0)), F.lit(0.0))
    size = F.abs(x)
    two = lambda e: F.pow(F.lit(2.0), e)
    guess = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(size)))).cast("int")
    # the logarithm may be off by one next to a power of two
    power = F.when((guess > -1022) & (size / two(guess) < 1), guess - 1).when((guess < 1023) & (size / two(guess) >= 2), guess + 1).otherwise(guess)
    least = F.lit(-1022)
    normal = F.shiftleft((power + 1023).cast("bigint"), 52) + ((size / two(power) - 1) * F.lit(2.0**52)).cast("bigint")
    tiny = (size / two(least) * F.lit(2.0**52)).cast("bigint")
    bits = F.when(size == float("inf"), F.lit(0x7FF << 52)).when(size < F.lit(2.0**-1022), tiny).otherwise(normal)
    return F.when(x < 0, -bits).otherwise(bits)


def over_cap(rows: DataFrame, max_count: int | None = None, max_share: float | None = None) -> DataFrame:
    """Identifiers of the rows to drop, once for each dropped row.

    ``rows`` has ``grp`` (the unit within which the cap holds), ``who`` (contributor,
    null = exempt), ``score`` (any number, the higher the better) and ``id`` (bigint).
    ``max_count`` caps the rows of a contributor in a unit, ``max_share`` their share of the
    unit's rows (at least one row stays); with both, the smaller holds.
    """
    if max_count is None and max_share is None:
        raise ValueError("max_count or max_share must be given")
    # bitwise not turns the order round: the best score first
    first = F.bitwise_not(ordered(F.col("score"), dict(rows.dtypes)["score"]))
    base = rows.where("who is not null").select("grp", "who", first.alias("a"), F.coalesce("id", F.lit(LAST)).alias("b"))
    spread = [F.count("*").alias("n"), F.min("a").alias("a_lo"), F.max("a").alias("a_hi"), F.min("b").alias("b_lo"), F.max("b").alias("b_hi")]
    ends = ["a_lo", "a_hi", "b_lo", "b_hi"]
    counts = base.groupBy("grp", "who").agg(*spread)
    caps = [F.lit(max_count).cast("bigint")] if max_count is not None else []
    if max_share is not None:
        size = rows.groupBy("grp").agg(F.count("*").alias("unit"))
        counts = counts.join(size, counts["grp"].eqNullSafe(size["grp"]), "left").drop(size["grp"])
        caps.append(F.greatest(F.lit(1), F.floor(F.col("unit") * F.lit(max_share))))
    over = counts.withColumn("rest", caps[0] if len(caps) == 1 else F.least(*caps)).where("n > rest").select(F.col("grp").alias("g"), F.col("who").alias("w"), "rest", *ends)
    current = cut(base.join(over, base["grp"].eqNullSafe(over["g"]) & (base["who"] == over["w"])).select("grp", "who", "a", "b", "rest", *ends))
    found = None
    while True:
        # rest: rows still to be kept of those that share the fixed bytes
        ended = (  # equal keys: no byte is left that tells them apart
            current.where("a_lo = a_hi and b_lo = b_hi").groupBy("grp", "who", "b").agg(F.count("*").alias("n"), F.first("rest").alias("rest"))
            .select(F.explode(F.expr("array_repeat(b, cast(n - rest as int))")).alias("id"))
        )
        digit = lambda c: F.expr(
            f"cast(shiftrightunsigned({c} ^ {SIGN}, cast(floor((length(bin({c}_lo ^ {c}_hi)) - 1) / 8) * 8 as int)) & 255 as short)"
        )
        split = current.where("a_lo < a_hi or b_lo < b_hi").withColumn("byte", F.when(F.col("a_lo") < F.col("a_hi"), digit("a")).otherwise(digit("b"))).select("grp", "who", "a", "b", "rest", "byte")
        counts = split.groupBy("grp", "who", "byte").agg(*spread, F.first("rest").alias("rest"))
        order = Window.partitionBy("grp", "who").orderBy("byte").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        left = F.col("rest") - (F.sum("n").over(order) - F.col("n"))
        past = counts.withColumn("left", left).where("left < n").select(
            F.col("grp").alias("g"), F.col("who").alias("w"), F.col("byte").alias("c"), F.greatest("left", F.lit(0)).alias("left"), *ends
        )
        same = split["grp"].eqNullSafe(past["g"]) & (split["who"] == past["w"]) & (split["byte"] == past["c"])
        hit = cut(split.join(past, same).select("grp", "who", "a", "b", F.col("left").alias("rest"), *ends))
        dropped = hit.where("rest = 0").select(F.col("b").alias("id")).unionAll(ended)
        found = dropped if found is None else found.unionAll(dropped)
        current = hit.where("rest > 0")
        if current.isEmpty():
            return found.select(F.when(F.col("id") != LAST, F.col("id")).alias("id"))
