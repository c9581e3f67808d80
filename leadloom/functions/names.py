"""Display names out of page titles: candidates, a score for each, the best one, all as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_spaces
from .urls import domain_display_name, let

# Words of titles that are no names.
GENERIC = ["トップページ", "ホーム", "home", "top", "index", "公式サイト", "ご予約", "ご案内", "初回限定メニュー"]


def candidates(title: Column) -> Column:
    """Parts of a title that may be its name, in order: text in quotes, then the parts between separators without a leading label."""
    # leading labels go before the ends are cleaned, which takes brackets away
    bare = clean_spaces(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)^[\s\x{FEFF}\x{200B}]*(?:【[^】]*】|\[[^\]]*\])\s*", ""))

    def parts(b: Column) -> Column:
        quotes = F.regexp_extract_all(b, F.lit(r"[「『“\"]([^」』”\"]{2,40})[」』”\"]"), F.lit(1))
        return F.concat(quotes, F.split(b, r"(?U)\s*[|｜–—]\s*|\s+[-/]\s+"))

    return F.array_distinct(F.filter(F.transform(let(bare, parts), clean_spaces), lambda x: F.length(x) > 0))


def name_score(name: Column, domain: Column, generic: Sequence[str] = tuple(GENERIC)) -> Column:
    """Score of a candidate: length, generic words, place words and likeness to the domain."""
    low = F.lower(name)
    out = F.lit(50) + F.when(F.length(name).between(2, 24), 20).when(F.length(name) > 40, -30).otherwise(0)
    out = out - F.when(low.isin(list(generic)), 60).otherwise(0) - F.when(name.rlike(r"[市区町村]の"), 25).otherwise(0)
    out = out - F.when(name.rlike(r"^[\p{IsHan}\p{IsKatakana}]{1,8}[市区町村]$"), 20).otherwise(0)
    word = F.lower(F.substring_index(domain, ".", 1))
    return (out + F.when((F.length(word) > 3) & F.contains(F.regexp_replace(low, r"[^a-z0-9]", ""), word), 15).otherwise(0)).cast("int")


def best_name(title: Column, domain: Column) -> Column:
    """Struct of the best candidate (the first on ties), its score, its source and a confidence; the domain's words if no candidate is good."""
    scored = F.transform(candidates(title), lambda x, i: F.struct(name_score(x, domain).alias("score"), (-i).alias("place"), x.alias("name")))

    def chosen(best: Column) -> Column:
        good = F.coalesce(best["score"] >= 40, F.lit(False))
        score = F.when(good, best["score"]).otherwise(F.lit(30))
        return F.struct(
            F.when(good, best["name"]).otherwise(domain_display_name(domain)).alias("name"), score.cast("int").alias("score"), F.when(good, "title").otherwise("domain").alias("source"),
            F.when(score >= 70, "high").when(score >= 50, "medium").otherwise("low").alias("confidence"),
        )

    return let(F.array_max(scored), chosen)
