"""Projections over pages: what a pattern can tell stays native; text that needs a parser goes through Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import contains_any


def element(html: Column, tag: str, limit: int = 200) -> Column:
    """Text of the first element of a kind on one line; '' if there is none."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(inner, r"(?s)<[^>]*>", " "), r"(?U)\s+", " ")), 1, limit)


def bare_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, on one line."""
    no_code = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_code, r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))


def meta(html: Column, name: str) -> Column:
    """Content of a meta element by name, property or itemprop; '' if there is none."""
    one = F.regexp_extract(html, rf"""(?is)<meta[^>]*(?:name|property|itemprop)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)
    two = F.regexp_extract(html, rf"""(?is)<meta[^>]*content=["']([^"']*)["'][^>]*(?:name|property|itemprop)=["']{name}["']""", 1)
    return F.when(one != "", one).otherwise(two)


def emails(text: Column, false_endings: Sequence[str] = (".png", ".jpg", ".gif")) -> Column:
    """Addresses in order of their first appearance, small letters."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"), F.lit(1)), F.lower))
    return F.filter(found, lambda x: ~x.rlike("(" + "|".join(e.replace(".", r"\.") for e in false_endings) + r")\z")) if false_endings else found


def phone_link(html: Column) -> Column:
    """Number of the first tel: link, else the first national number in the text; '' if there is none."""
    link = F.regexp_extract(html, r"""(?i)href=["']tel:([+0-9()\- ]{9,})["']""", 1)
    number = F.regexp_extract(html, r"(?<![0-9\-])(0\d{1,4}-\d{1,4}-\d{3,4})(?![0-9\-])", 1)
    return F.when(link != "", link).otherwise(number)


def first_listed(text: Column, names: Sequence[str]) -> Column:
    """First of the listed names, in the list's order, that the text holds; null if none."""
    return F.try_element_at(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(text, n)), F.lit(1)) if names else F.lit(None).cast("string")


def signals(html: Column, words: dict[str, Sequence[str]], thin: int = 400) -> list[Column]:
    """Flags of a page: one for each list of words, its text length, and whether it is thin."""
    body = F.lower(bare_text(html))
    flags = [contains_any(body, w).alias(n) for n, w in words.items()]
    return [*flags, F.length(body).alias("text_length"), (F.length(body) < thin).alias("thin")]


def name_chain(html: Column, domain_name: Column) -> Column:
    """Name of a page's shop: first heading, site name, first part of the title, words of the domain; the first that is filled and no longer than 60 letters."""
    part = F.trim(F.element_at(F.split(element(html, "title"), r"[|｜]"), 1))
    usable = [F.when(F.length(x).between(1, 60), x) for x in (element(html, "h1"), meta(html, "og:site_name"), part, domain_name)]
    return F.coalesce(*usable, F.lit("Unknown"))


def near_word(text: Column, words: Sequence[str], pattern: str, within: int = 100) -> Column:
    """First match of a pattern at most ``within`` letters after one of the words; '' if there is none."""
    start = "(?:" + "|".join(words) + ")"
    return F.regexp_extract(text, rf"(?s){start}.{{0,{within}}}?({pattern})", 1)


def hours(text: Column) -> Column:
    """Opening hours after their label."""
    return near_word(text, ["営業時間", "受付時間", "hours"], r"\d{1,2}[:：時]\d{0,2}分?\s*[-~〜–]\s*\d{1,2}[:：時]\d{0,2}")


def postal_code(text: Column) -> Column:
    """First postal code as seven digits with a hyphen; '' if there is none."""
    code = F.regexp_extract(F.translate(text, "０１２３４５６７８９－‐−", "0123456789---"), r"(?:〒\s*|(?<![0-9\-]))(\d{3}-?\d{4})(?![0-9\-])", 1)
    return F.when(code != "", F.concat_ws("-", F.substring(code, 1, 3), F.substring(code, -4, 4))).otherwise("")


def listing_signals(text: Column, title: Column, words: Sequence[str], often: int = 5, kinds: int = 3) -> Column:
    """Whether a page lists many businesses: a count of picks in its title, or ``kinds`` of the words each more than ``often`` times."""
    many = F.lit(0)
    for w in words:
        many = many + F.when((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w) > often, 1).otherwise(0)
    return F.coalesce(title.rlike(r"\d{1,3}選"), F.lit(False)) | F.coalesce(many >= kinds, F.lit(False))


class _Reader(HTMLParser):
    """Collects visible text, links and JSON-LD of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.text, self.links, self.data, self.in_data = 0, [], [], [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        self.in_data = tag == "script" and (a.get("type") or "").lower() == "application/ld+json"
        self.hidden += tag in ("script", "style", "noscript", "template")
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript", "template"):
            self.hidden, self.in_data = max(0, self.hidden - 1), False

    def handle_data(self, data: str) -> None:
        if self.in_data:
            self.data.append(data)
        elif not self.hidden and data.strip():
            self.text.append(" ".join(data.split()))


def names_in(node: object, kinds: Sequence[str]) -> Iterator[str]:
    """Names of organisations of the given kinds in a JSON-LD document."""
    if isinstance(node, list):
        for x in node:
            yield from names_in(x, kinds)
    elif isinstance(node, dict):
        kind = node.get("@type")
        if (set(kind) if isinstance(kind, list) else {kind}) & set(kinds) and isinstance(node.get("name"), str):
            yield node["name"].strip()
        yield from names_in(node.get("@graph"), kinds)


def read_pages(pages: DataFrame, key: str, kinds: Sequence[str] = ("LocalBusiness", "Organization", "ProfessionalService")) -> DataFrame:
    """``key, text, links, names`` of ``key, url, html``: visible text, same-host links made absolute, names in JSON-LD; a broken page gives what could be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                r = _Reader()
                r.feed(html or "")
                host, links = urlsplit(url or "").netloc.lower(), []
                for href in r.links:
                    try:
                        full = urljoin(url or "", href).split("#")[0]
                        if urlsplit(full).netloc.lower() == host and full.startswith("http"):
                            links.append(full)
                    except ValueError:
                        continue
                found = []
                for d in r.data:
                    try:
                        found += names_in(json.loads(d), kinds)
                    except ValueError:
                        continue
                out[0].append(" ".join(r.text))
                out[1].append(list(dict.fromkeys(links)))
                out[2].append(list(dict.fromkeys(found)))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out[0], pa.string()), *[pa.array(c, pa.list_(pa.string())) for c in out[1:]]], names=[key, "text", "links", "names"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, "url", "html").mapInArrow(run, f"{key} {kind}, text string, links array<string>, names array<string>")
