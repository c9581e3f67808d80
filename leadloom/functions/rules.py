"""Rule tables as data, and their compilation to expressions.

A rule set is a list of :class:`Rule` (or a DataFrame with the same columns, see
``as_table``). Operators take rule sets as parameters, so a new rule never needs new
code; all expressions stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "gclsrc", "dclid", "msclkid",
                   "ref", "referer", "referrer", "source", "affiliate", "_ga", "_gl", "mc_cid", "mc_eid"]
JUNK_EXTENSIONS = [".pdf", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".mp4", ".mp3", ".wav", ".avi", ".mov", ".zip", ".rar", ".gz", ".tar",
                   ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".css", ".js", ".xml", ".json"]
JUNK_PATHS = ["/tag/", "/tags/", "/category/", "/categories/", "/wp-content/", "/wp-includes/", "/wp-admin/", "/search", "?s=", "utm_", "fbclid", "gclid",
              "/page/", "/feed/", "/comment/", "/comments/", "/archive/", "/archives/", "/author/", "/login", "/signup", "/register", "/cart", "/checkout"]
PREFERRED_PATHS = ["/", "/index", "/about", "/profile", "/concept", "/company", "/contact", "/access", "/menu", "/service", "/price"]
BUSINESS_PATHS = ["/menu", "/price", "/service", "/access", "/contact", "/about", "/profile"]
FREE_PLATFORMS = {
    "peraichi": ["peraichi.com"], "crayon": ["crayon.e-shops.jp", "crayonsite.info", "crayonsite.net", "crayonsite.com"], "jimdo": ["jimdo", "jindo", "jimdofree"],
    "wix": ["wixsite.com", "wix.com"], "ameblo": ["ameblo.jp", "ameba.jp"], "amebaownd": ["amebaownd.com", "ownd.jp"], "fc2": ["fc2.com"], "note": ["note.com"],
    "studio.site": ["studio.site"], "lit.link": ["lit.link"], "linktree": ["linktr.ee"], "thebase": ["thebase.in"], "base.shop": ["base.shop"], "stores": ["stores.jp"],
    "goope": ["goope.jp"], "wordpress": ["wp-content", "wordpress"],
}
FOREIGN_TLDS = [
    ".de", ".fr", ".es", ".it", ".nl", ".pt", ".pl", ".ru", ".se", ".no", ".dk", ".fi", ".cz", ".at", ".ch", ".be", ".ie", ".gr", ".hu", ".ro",
    ".bg", ".hr", ".sk", ".si", ".lt", ".lv", ".ee", ".co.uk", ".org.uk", ".me.uk", ".com.au", ".com.br", ".com.mx", ".com.ar", ".com.co", ".com.tr",
    ".com.sa", ".com.eg", ".co.za", ".co.ke", ".co.in", ".co.id", ".co.th", ".co.kr", ".com.cn", ".com.tw", ".com.hk", ".com.sg", ".com.my",
    ".com.ph", ".com.vn", ".in", ".cn", ".kr", ".tw", ".th", ".vn", ".ph", ".my", ".sg", ".id",
]
JP_PLATFORMS = [
    "peraichi.com", "jimdofree.com", "wixsite.com", "wordpress.com", "studio.site", "crayonsite.com", "crayonsite.net", "webnode.jp", "weebly.com",
    "strikingly.com", "goope.jp", "shopify.com", "jimdo.com", "wix.com", "squarespace.com", "base.shop", "stores.jp", "thebase.in", "booth.pm",
    "google.com",
]
JP_SIGNALS = ["japan", "tokyo", "osaka", "kyoto", "nagoya", "yokohama", "sapporo", "fukuoka", "sendai", "hiroshima", "kobe", "/jp/", "/ja/", "-jp", "_jp"]


@dataclass(frozen=True)
class Rule:
    """One row of a rule table: a pattern, what it gives, and its place among the rules of its set."""

    pattern: str
    reason: str = ""
    points: int = 0


def as_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """A rule set as a DataFrame ``ord, pattern, reason, points``."""
    return spark.createDataFrame([(i, r.pattern, r.reason, r.points) for i, r in enumerate(rules)], "ord int, pattern string, reason string, points int")


def patched(rules: Sequence[Rule], added: Sequence[Rule]) -> list[Rule]:
    """The union of a rule set with new rules; known patterns keep their rule and their place."""
    known = {r.pattern for r in rules}
    out = list(rules)
    for r in added:
        if r.pattern not in known:
            known.add(r.pattern)
            out.append(r)
    return out


def reverted(rules: Sequence[Rule], added: Sequence[Rule], before: Sequence[Rule]) -> list[Rule]:
    """A patched rule set without what the patch added; rules that were there before stay."""
    known, gone = {r.pattern for r in before}, {r.pattern for r in added}
    return [r for r in rules if r.pattern in known or r.pattern not in gone]


def contains_any(text: Column, words: Sequence[str], ignore_case: bool = True) -> Column:
    """Whether a text holds one of the words; false for null and for no words."""
    low = F.lower(text) if ignore_case else text
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower() if ignore_case else w))
    return F.coalesce(out, F.lit(False))


def first_match(text: Column, rules: Sequence[Rule]) -> Column:
    """Reason (or the pattern, if it has none) of the first rule in order whose pattern the text holds; null if none does."""
    low, out = F.lower(text), None
    for r in rules:
        hit, gives = F.contains(low, F.lit(r.pattern.lower())), F.lit(r.reason or r.pattern)
        out = F.when(hit, gives) if out is None else out.when(hit, gives)
    return F.lit(None).cast("string") if out is None else out


def points(text: Column, rules: Sequence[Rule], cap: int | None = None) -> Column:
    """Sum of the points of all rules whose pattern the text holds, at most ``cap`` (at least, if it is negative)."""
    low, out = F.coalesce(F.lower(text), F.lit("")), F.lit(0)
    for r in rules:
        out = out + F.when(F.contains(low, F.lit(r.pattern.lower())), r.points).otherwise(0)
    return out if cap is None else (F.least(out, F.lit(cap)) if cap >= 0 else F.greatest(out, F.lit(cap)))


def reasons(pairs: Sequence[tuple[Column, str]]) -> Column:
    """Ordered array of the reasons whose condition holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in pairs])) if pairs else F.array().cast("array<string>")


def scorecard(rules: Sequence[tuple[Column, int, str]], start: Column | int = 0, low: int | None = None, high: int | None = None) -> tuple[Column, Column]:
    """Additive scorecard: (score, ordered reasons) of rules (condition, points, reason), clamped to low..high."""
    score = F.lit(start) if isinstance(start, int) else start
    for cond, pts, _ in rules:
        score = score + F.when(F.coalesce(cond, F.lit(False)), pts).otherwise(0)
    if high is not None:
        score = F.least(score, F.lit(high))
    if low is not None:
        score = F.greatest(score, F.lit(low))
    return score.cast("int"), reasons([(c, r) for c, _, r in rules])


def first_reason(chain: Sequence[tuple[Column, Column | str]]) -> Column:
    """First-match-wins chain of (condition, reason); '' if no condition holds."""
    out = None
    for cond, reason in chain:
        gives = F.lit(reason) if isinstance(reason, str) else reason
        out = F.when(cond, gives) if out is None else out.when(cond, gives)
    return F.lit("") if out is None else F.coalesce(out, F.lit(""))
