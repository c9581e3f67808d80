"""Fields of pages as expressions: contacts, people, places, text blocks and links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import bare_text, element, first_listed, meta
from .urls import let, netloc, path, same_host

JAPANESE = "ぁ-んァ-ヶー一-龯"
NO_EMAILS = ("example@", "test@", "info@example", "@2x.png", "@gmail.png")
OWNERS = ("代表者", "オーナー", "院長", "店長", "代表")
ENDINGS = ("サロン", "整体院", "接骨院", "鍼灸院", "教室", "スタジオ", "美容室", "写真館")


def first_email(html: Column, no: Sequence[str] = NO_EMAILS) -> Column:
    """Address of the first mailto link that holds one, else the first one in the page that isn't a known false one; '' if there is none."""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"""(?i)href=["']mailto:([^"'?]*)"""), F.lit(1)), lambda x: F.contains(x, F.lit("@")))
    false = lambda x: F.exists(F.array(*[F.lit(w) for w in no]), lambda w: F.contains(F.lower(x), w))
    texts = F.filter(F.regexp_extract_all(html, F.lit(r"([A-Za-z0-9_.\-]+@[A-Za-z0-9_.\-]+\.[A-Za-z0-9_]+)"), F.lit(1)), lambda x: ~false(x))
    return F.coalesce(F.trim(F.try_element_at(links, F.lit(1))), F.try_element_at(texts, F.lit(1)), F.lit(""))


def first_phone(html: Column) -> Column:
    """Digits of the first tel link, else the first number with hyphens, else without, else with country code, each at most 20 characters; '' if there is none."""
    link = F.regexp_replace(F.regexp_extract(html, r"""(?i)href=["']tel:([^"']*)["']""", 1), r"[^0-9+\-]", "")
    forms = [F.regexp_extract(html, p, 0) for p in (r"0[0-9]{1,4}-[0-9]{1,4}-[0-9]{3,4}", r"0[0-9]{9,10}", r"\+81[0-9\-]{10,}")]
    return F.coalesce(*[F.when(x != "", F.substring(x, 1, 20)) for x in (link, *forms)], F.lit(""))


def address_window(text: Column, places: Sequence[str], before: int = 20, after: int = 80, most: int = 100) -> Column:
    """What follows the first postal code (10 to 50 letters), else the surroundings of the first listed place that the text holds; '' if there is none."""
    code = F.trim(F.regexp_extract(text, r"〒?\s*[0-9]{3}-?[0-9]{4}\s*([^\n]{10,50})", 1))
    place = first_listed(text, places)
    near = let(F.struct(text.alias("t"), place.alias("p")), lambda x: let(F.position(x["p"], x["t"]), lambda at: F.substring(x["t"], F.greatest(F.lit(1), at - before), F.least(at - 1, F.lit(before)) + after)))
    return F.when(code != "", F.substring(code, 1, most)).when(place.isNotNull(), F.substring(F.trim(F.regexp_replace(near, r"(?U)\s+", " ")), 1, most)).otherwise("")


def owner_name(text: Column, html: Column, words: Sequence[str] = OWNERS) -> Column:
    """Japanese name that follows one of the words, in the words' order, else the author that a meta element names; '' if there is none."""
    named = [F.regexp_extract(text, rf"{w}[^{JAPANESE}]{{0,5}}([{JAPANESE}]{{2,10}})", 1) for w in words]
    author = meta(html, "author")
    return F.coalesce(*[F.when(n != "", n) for n in named], F.when(F.length(author).between(1, 29), author), F.lit(""))


def japanese_name(text: Column, endings: Sequence[str] = ENDINGS, most: int = 50) -> Column:
    """First name of a business: Japanese letters up to the ending of a kind of business; '' if there is none."""
    return F.substring(F.regexp_extract(text, rf"([{JAPANESE}・]{{1,30}}(?:{'|'.join(endings)}))", 1), 1, most)


def blocks(html: Column, heads: int = 200, main: int | None = None, footer: int | None = None) -> Column:
    """Struct of the texts of title, first heading, main part (else body) and footer, and all of them in one line.

    Parts are whole unless a length is given; headings have one by default.
    """
    part = lambda tag, n: element(html, tag, n or 1_000_000_000)
    parts = F.struct(part("title", heads).alias("title"), part("h1", heads).alias("h1"), F.when(part("main", main) != "", part("main", main)).otherwise(part("body", main)).alias("main"), part("footer", footer).alias("footer"))
    return let(parts, lambda p: F.struct(p["title"], p["h1"], p["main"], p["footer"], F.trim(F.regexp_replace(F.concat_ws(" ", p["title"], p["h1"], p["main"], p["footer"]), " +", " ")).alias("combined")))


def resolve(base: Column, href: Column) -> Column:
    """A link made absolute: full addresses stay, others follow the address of their page; dots in paths are left as they are."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.concat(scheme, F.lit("://"), netloc(base))
    folder = F.regexp_replace(path(base), r"[^/]*\z", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(root, href))
        .when(href == "", base).when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*\z", ""), href)).when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*\z", ""), href))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    )


def first_link(html: Column, base: Column, patterns: Sequence[str]) -> Column:
    """The first link of a page, on the same host, whose address or text holds one of the patterns in any letter case; null if there is none."""
    anchor = r"""(?is)<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(anchor), F.lit(2)).alias("text"))
    listed = F.array(*[F.lit(p.lower()) for p in patterns])
    wanted = lambda x: ~F.lower(F.trim(x["href"])).rlike("^(mailto|tel|javascript):") & F.exists(listed, lambda p: F.contains(F.lower(F.concat_ws(" ", x["href"], x["text"])), p))
    full = F.transform(F.filter(pairs, wanted), lambda x: resolve(base, F.trim(x["href"])))
    return F.try_element_at(F.filter(full, lambda u: same_host(u, base)), F.lit(1))


def contact_evidence(pages: DataFrame, contacts: DataFrame) -> DataFrame:
    """Pages with what their contact page shows: ``contact_link, contact_status, contact_form, contact_text, line_link``.

    ``pages`` has ``page_id, url, html``, ``contacts`` one row for each ``url`` with ``status`` and ``html``. Only a
    contact page on the same host counts; one that wasn't fetched has the status ``not_fetched``, no link ``none``.
    """
    linked = pages.withColumn("contact_link", first_link(F.col("html"), F.col("url"), ["contact", "inquiry", "お問い合わせ", "問合せ"]))
    side = contacts.select(F.col("url").alias("contact_link"), F.col("status").alias("_status"), F.col("html").alias("_html"))
    out = linked.join(side, "contact_link", "left")
    form = F.contains(F.lower(F.col("_html")), F.lit("<form"))
    return out.select(
        "page_id", "contact_link", F.when(F.col("contact_link").isNull(), "none").when(F.col("_status").isNull(), "not_fetched").otherwise(F.col("_status")).alias("contact_status"),
        F.coalesce(form, F.lit(False)).alias("contact_form"), F.coalesce(bare_text(F.col("_html")), F.lit("")).alias("contact_text"),
        F.coalesce(F.col("html").rlike(r"(?i)lin\.ee|line\.me"), F.lit(False)).alias("line_link"),
    )
