"""Predicates with reasons over URL, title and text; rule sets are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rule, first_match, first_reason
from ..functions.urls import domain_key, host_in


def reason_chain(
    url: Column, title: Column, government: Sequence[str] = (), blocked: Sequence[str] = (), media: Sequence[str] = (), keywords: Sequence[Rule] = (),
    local: str = r"[\x{3040}-\x{30FF}]", lists: str = r"[0-9]{1,3}選",
) -> Column:
    """First reason to leave a page out: government suffix, blocked domain, media domain without local words, keyword, list page; '' for none."""
    dom, low = domain_key(url), F.lower(F.coalesce(title, F.lit("")))
    gov = F.lit(False)
    for g in government:
        gov = gov | dom.endswith(g)
    chain: list[tuple[Column, Column | str]] = [(gov, "domain:gov")]
    chain += [(host_in(dom, [b]), f"domain:{b}") for b in blocked]
    chain.append((host_in(dom, media) & ~low.rlike(local), "domain:media"))
    word = first_match(low, keywords)
    chain.append((word.isNotNull(), F.concat(F.lit("keyword:"), word)))
    chain.append((low.rlike(lists), "list_page"))
    return first_reason(chain)


def split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, left out with ``filter_reason``)."""
    tagged = df.withColumn("filter_reason", reason)
    return tagged.where("filter_reason = ''").drop("filter_reason"), tagged.where("filter_reason <> ''")


def in_range(score: Column, low: int | None = None, high: int | None = None, exempt: Column | None = None) -> Column:
    """Score within optional bounds; exempt rows always pass, a null score never does once a bound is set."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (score >= low)
    if high is not None:
        ok = ok & (score <= high)
    ok = F.coalesce(ok, F.lit(False))
    return ok if exempt is None else ok | F.coalesce(exempt, F.lit(False))
