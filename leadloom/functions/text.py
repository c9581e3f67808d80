"""Column resolution and text, number, date, JSON and hash functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import strip

JP = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}]"


def header_key(name: str) -> str:
    """A header without BOM, width, case and space differences."""
    return "".join(unicodedata.normalize("NFKC", name.replace("﻿", "")).lower().split())


def pick(df: DataFrame, names: Sequence[str], loose: bool = True) -> Column:
    """First non-blank value among the columns that ``names`` lists; '' if none. Columns are resolved when the plan is made.

    With ``loose``, headers also match without regard to BOM, width, letter case and space.
    """
    found = [c for n in names for same in ((lambda c: c == n), (lambda c: loose and header_key(c) == header_key(n))) for c in df.columns if same(c)]
    blank = lambda c: F.when(strip(F.col(f"`{c}`").cast("string")) != "", strip(F.col(f"`{c}`").cast("string")))
    return F.coalesce(*[blank(c) for c in dict.fromkeys(found)], F.lit(""))


def pick_with_source(df: DataFrame, names: Sequence[str]) -> Column:
    """Like ``pick``, as a struct of the value and the header that it came from."""
    out = F.lit(None).cast("struct<value:string,source:string>")
    for c in reversed([c for n in names for c in df.columns if header_key(c) == header_key(n)]):
        v = strip(F.col(f"`{c}`").cast("string"))
        out = F.when(v != "", F.struct(v.alias("value"), F.lit(c).alias("source"))).otherwise(out)
    return out


def sanitize(c: Column, limit: int | None = None) -> Column:
    """One line: runs of white space become a space; longer texts end with an ellipsis at ``limit`` letters."""
    s = strip(F.regexp_replace(c, r"(?U)[\s]+", " "))
    return s if limit is None else F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 1), F.lit("…"))).otherwise(s)


def store_name_key(c: Column) -> Column:
    """Name for comparison: small letters without space and punctuation, digits half width; '' for null."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[・\-_\s.,!?'\"()\[\]{}/\\【】「」『』（）]", "")
    return F.translate(s, "０１２３４５６７８９", "0123456789")


def clean_spaces(c: Column) -> Column:
    """One line without BOM and zero-width space; runs of white space, wide spaces too, become a space; separators and square brackets at the ends go."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x{FEFF}\x{200B}]", "")
    return F.regexp_replace(F.regexp_replace(s, r"(?U)[\s\x{3000}]+", " "), r"^[ \-–—|｜:：／/\[\]【】]+|[ \-–—|｜:：／/\[\]【】]+$", "")


def snippet(c: Column, word: str, around: int = 18) -> Column:
    """The word's first occurrence with its surroundings on one line; null if it doesn't occur."""
    at = F.instr(c, word)
    lo = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, sanitize(F.substring(c, lo, at + len(word) + around - lo)))


def phone(c: Column) -> Column:
    """Telephone number in the national hyphenated form; '' if it can't be one."""
    d = F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", ""), 1, 11)
    cut = lambda *at: F.concat_ws("-", *[F.substring(d, a, n) for a, n in at])
    ten = F.when(d.rlike("^0[346]"), cut((1, 2), (3, 4), (7, 4))).when(d.rlike("^(012|050)"), cut((1, 4), (5, 3), (8, 3))).otherwise(cut((1, 3), (4, 3), (7, 4)))
    eleven = F.when(d.rlike("^0[789]0"), cut((1, 3), (4, 4), (8, 4))).otherwise(cut((1, 4), (5, 2), (7, 5)))
    bad = d.rlike(r"^(\d)\1{3}") | (F.length(d) < 10)
    return F.when(bad, "").when(F.length(d) == 10, ten).otherwise(eleven)


def truth(c: Column) -> Column:
    """'1', '0' or '' of a truth word."""
    s = F.lower(strip(c.cast("string")))
    return F.when(s.isin("1", "true", "yes", "y", "on", "あり", "有", "○"), "1").when(s.isin("0", "false", "no", "n", "off", "なし", "無", "×"), "0").otherwise("")


def reason_key(c: Column) -> Column:
    """Text before the first colon."""
    return F.substring_index(c, ":", 1)


def repeat_ratio(c: Column, least_words: int = 20) -> Column:
    """Share of different words, null for texts of up to ``least_words`` words."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > least_words, F.bround(F.size(F.array_distinct(words)) / F.size(words), 6))


def evidence(c: Column, key: str) -> Column:
    """Value of ``key=value`` in a text of entries joined by ' | '; null if it is missing."""
    v = F.regexp_extract(c, rf"(?:^|\| ){key}=(.*?)(?= \| |$)", 1)
    return F.when(v != "", v)


def token_match(c: Column, tokens: Sequence[str]) -> Column:
    """Whether a token occurs; short ASCII tokens only as whole words."""
    low, out = F.lower(c), F.lit(False)
    for t in tokens:
        word = t.isascii() and len(t) <= 4
        out = out | (low.rlike(rf"(?<![a-z0-9]){t.lower()}(?![a-z0-9])") if word else F.contains(low, F.lit(t.lower())))
    return F.coalesce(out, F.lit(False))


def whole_number(c: Column) -> Column:
    """Integer of up to 38 digits of a text that is one, as a decimal; null otherwise. Longer ones become the largest or smallest."""
    s = F.regexp_extract(c.cast("string"), r"^\s*([+-]?)0*(\d+)\s*$", 0)
    sign, digits = (F.regexp_extract(c.cast("string"), r"^\s*([+-]?)0*(\d+)\s*$", i) for i in (1, 2))
    most = F.when(F.length(digits) > 38, F.lit("9" * 38)).otherwise(digits)
    return F.when(s != "", F.concat(F.when(sign == "-", "-").otherwise(""), most).try_cast("decimal(38,0)"))


def score_0_100(c: Column) -> Column:
    """Score clamped to 0..100, 0 if it isn't a whole number."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(whole_number(c), F.lit(0)))).cast("int")


def decimal_number(c: Column) -> Column:
    """Number of a text with or without thousands commas; 0 if it is none."""
    return F.coalesce(F.replace(strip(c.cast("string")), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def ratio(n: Column, d: Column) -> Column:
    """Ratio rounded half-even to 6 places; 0 for an empty base."""
    return F.when(d > 0, F.bround(n / d, 6)).otherwise(F.lit(0.0))


def jst_time(c: Column) -> Column:
    """Instant of a local (+09:00) time text with - or /; null if it is none."""
    s = F.replace(strip(c), F.lit("/"), F.lit("-"))
    t = F.try_to_timestamp(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), s), F.lit("yyyy-MM-dd HH:mm:ss"))
    return t - F.expr("interval 9 hours")


def literal_date(c: Column) -> Column:
    """Date with which a text starts; offsets are not applied."""
    return F.to_date(F.try_to_timestamp(F.regexp_extract(c, r"^\s*(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")))


def earliest_year(c: Column, low: int = 1990, high: int = 2100) -> Column:
    """Smallest year of copyright notices in a text; null if there is none."""
    years = F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(?:©|\(c\)|copyright)\D{0,20}?((?:19|20)\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_min(F.filter(years, lambda y: y.between(low, high)))


def json_object(c: Column) -> Column:
    """The first to the last brace of a text that holds a JSON object in prose or fences; null if there is none."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def short_hash(c: Column, size: int = 12) -> Column:
    return F.substring(F.sha2(c, 256), 1, size)


def has_japanese(c: Column) -> Column:
    return F.coalesce(c.rlike(JP), F.lit(False))


def japanese_ratio(c: Column) -> Column:
    """Share of Japanese letters; 0 for null and empty."""
    n = F.length(c)
    return F.when(n > 0, F.bround((n - F.length(F.regexp_replace(c, JP, ""))) / n, 6)).otherwise(F.lit(0.0))


def occurrences(c: Column, word: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def run_times(now: Column) -> tuple[Column, Column]:
    """(local +09:00 time as ISO text, run identifier YYYYMMDD_HHMMSS) of an instant that is an input, so that a run can be repeated."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), now.cast("timestamp_ntz"))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")), F.date_format(local, "yyyyMMdd_HHmmss")
