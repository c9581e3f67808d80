"""Enum-valued expressions: response class, labels, grades, language class, size class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rules import contains_any
from ..functions.text import has_japanese, japanese_ratio
from ..functions.urls import host_in, is_foreign


def response_class(status: Column, content_type: Column, body: Column, block_words: Sequence[str] = ("captcha", "access denied", "cloudflare")) -> tuple[Column, Column]:
    """(class, code) of a response: OK, BLOCKED (403, 429, or 401 and 503 with a blocking page) or INVALID."""
    blocked = status.isin(403, 429) | (status.isin(401, 503) & contains_any(body, block_words))
    html = F.coalesce(F.lower(content_type), F.lit(""))
    kind = F.when(status >= 400, F.when(blocked, "BLOCKED").otherwise("INVALID")).when((html != "") & ~F.contains(html, F.lit("text/html")), "INVALID").otherwise("OK")
    code = F.when(status >= 400, F.concat(F.when(blocked, "BLOCKED_").otherwise("HTTP_"), status.cast("string"))).when(kind == "INVALID", "NON_HTML").otherwise("OK")
    return kind, code


def alive(status: Column) -> Column:
    """Liveness of a final response: 404, 410 and server errors are dead, no response too, all others alive."""
    return F.coalesce(~(status.isin(404, 410) | (status >= 500)), F.lit(False))


def grade(score: Column, a: int = 60, b: int = 40) -> Column:
    return F.when(score >= a, "A").when(score >= b, "B").otherwise("C")


def first_class(chain: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """First-match-wins classification."""
    out = None
    for cond, name in chain:
        hit = F.coalesce(cond, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def url_language(url: Column, title: Column, national: Sequence[str], overseas: Sequence[str]) -> Column:
    """japanese, overseas or uncertain by domain, top-level domain and script of the title."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), r"^www\.", "")
    return first_class(
        [(host.endswith(".jp") | host_in(host, national), "japanese"), (host_in(host, overseas) | is_foreign(url), "overseas"),
         ((japanese_ratio(title) >= 0.3) | (has_japanese(title) & host.endswith(".com")), "japanese")], "uncertain",
    )


def platform(url: Column, html: Column, platforms: dict[str, Sequence[str]]) -> Column:
    """First platform in order whose pattern stands in the address or the page; 'custom' for none."""
    both = F.concat_ws(" ", url, html)
    return first_class([(contains_any(both, pats), name) for name, pats in platforms.items()], "custom")
