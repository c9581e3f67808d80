"""URL and domain functions; every variant of normalisation has its own name.

All are expressions of built-in functions. Null gives null unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import BUSINESS_PATHS, FOREIGN_TLDS, JP_PLATFORMS, JP_SIGNALS, JUNK_EXTENSIONS, JUNK_PATHS, PREFERRED_PATHS, TRACKING_PARAMS, contains_any


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def netloc(url: Column) -> Column:
    """Authority as written (user, host, port), '' without scheme."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def with_scheme(url: Column) -> Column:
    """https:// put before an address without http scheme."""
    u = strip(url)
    return F.when(u.rlike(r"^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def drop_params(q: Column, names: Sequence[str], prefixes: Sequence[str] = ()) -> Column:
    """Query string without the parameters of the given names (in any letter case) or prefixes."""
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    unwanted = lambda p: key(p).isin(list(names)) | (key(p).rlike("^(" + "|".join(prefixes) + ")") if prefixes else F.lit(False))
    return F.array_join(F.filter(F.split(q, "&"), lambda p: (p != "") & ~unwanted(p)), "&")


def normalize_strict(url: Column) -> Column:
    """https, host in small letters without leading www., no tracking parameters, fragment or trailing slash; '' for blank."""

    def build(u: Column) -> Column:
        host = F.regexp_replace(F.lower(netloc(u)), r"^www\.", "")
        p = F.regexp_replace(path(u), r"/+\z", "")
        q = F.when(F.contains(u, F.lit("?")), drop_params(query(u), TRACKING_PARAMS)).otherwise("")
        tail = let(q, lambda x: F.when(x != "", F.concat(F.lit("?"), x)).otherwise(""))
        return F.concat(F.lit("https://"), host, let(p, lambda x: F.when(x == "", "/").otherwise(x)), tail)

    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(let(with_scheme(url), build))


def normalize_key(url: Column) -> Column:
    """Deduplication key: scheme and host in small letters without www., path without trailing slashes, nothing else."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    return F.concat(scheme, F.lit("://"), F.regexp_replace(F.lower(netloc(url)), r"^www\.", ""), F.regexp_replace(path(url), r"/+\z", ""))


def normalize_web(url: Column) -> Column:
    """Cut at '#'; trailing slashes go if more than three slashes stand in the address."""
    u = F.substring_index(url, "#", 1)
    return F.when(F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit(""))) > 3, F.regexp_replace(u, r"/+\z", "")).otherwise(u)


def normalize_legacy(url: Column) -> Column:
    """Host and path in small letters without trailing slashes."""
    return F.lower(F.regexp_replace(F.concat(netloc(url), path(url)), r"/+\z", ""))


def normalize_sheet(url: Column) -> Column:
    """https by default, no fragment, utm_*, fbclid or gclid; scheme, letter case and www stay."""
    u = strip(url)
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    u = F.substring_index(with_scheme(u), "#", 1)
    p = F.when(path(u) == "/", "/").otherwise(F.regexp_replace(path(u), r"/+\z", ""))
    q = drop_params(query(u), ["fbclid", "gclid"], ["utm_"])
    out = F.concat(F.regexp_extract(u, r"^(https?)://", 1), F.lit("://"), netloc(u), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(out)


def domain_plain(url: Column) -> Column:
    return F.lower(netloc(url))


def domain_any_www(url: Column) -> Column:
    """'www.' taken out wherever it stands."""
    return F.replace(F.lower(netloc(url)), F.lit("www."), F.lit(""))


def domain_key(url: Column) -> Column:
    """Leading www. taken out; https assumed without scheme."""
    return F.regexp_replace(F.lower(netloc(with_scheme(url))), r"^www\.", "")


def clean_domain(value: Column) -> Column:
    """Bare domain of a domain or URL: no user, path, port, outer dots or www.; '' unless a dot is left."""
    v = F.lower(strip(value))
    v = F.when(F.contains(v, F.lit("://")), F.regexp_extract(v, r"://([^/?#]*)", 1)).otherwise(v)
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"^.*@", ""), r"[/?#].*$", ""), r":.*$", "")
    v = F.regexp_replace(F.regexp_replace(v, r"^\.+|\.+$", ""), r"^www\.", "")
    return F.when(F.contains(v, F.lit(".")), v).otherwise("")


def first_domain(*values: Column) -> Column:
    """First usable domain among several fields; links like tel: or mailto: are none."""
    usable = [F.when(~F.lower(strip(v)).rlike(r"^(tel|mailto|line|sms|javascript|data):"), let(clean_domain(v), lambda d: F.when(d != "", d))) for v in values]
    return F.coalesce(*usable, F.lit(""))


def is_web_url(url: Column) -> Column:
    """A public http(s) address: with host, not localhost or .local."""
    host = F.regexp_replace(F.lower(netloc(url)), r":\d+$", "")
    return F.coalesce(url.rlike(r"^https?://[^/?#]+") & (host != "localhost") & ~host.endswith(".local"), F.lit(False))


def origin(url: Column) -> Column:
    """Struct of ``origin`` and ``error`` of an address: INVALID_URL, INVALID_SCHEME, MISSING_HOST, IP_HOST, NON_PUBLIC_HOST, INVALID_TLD or null."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

    def host_of(auth: Column) -> Column:
        return F.lower(F.when(auth.startswith("["), F.regexp_extract(auth, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(auth, r":\d*\z", "")))

    def error_of(x: Column) -> Column:
        host = x["host"]
        return (
            F.when(x["url"] == "", "INVALID_URL").when(~F.lower(x["url"]).rlike("^https?:"), "INVALID_SCHEME").when(host == "", "MISSING_HOST")
            .when(host.rlike(rf"^{octet}(\.{octet}){{3}}$") | F.contains(host, F.lit(":")), "IP_HOST")
            .when((host == "localhost") | host.rlike(r"\.(local|internal|lan)$"), "NON_PUBLIC_HOST").when(~F.contains(host, F.lit(".")), "INVALID_TLD")
        )

    def made(x: Column) -> Column:
        return F.concat(F.lit("https://"), x["host"], F.when((x["port"] != "") & (x["port"] != "0"), F.concat(F.lit(":"), x["port"])).otherwise(""))

    parts = let(strip(F.coalesce(url, F.lit(""))), lambda u: let(F.regexp_replace(netloc(u), "^.*@", ""), lambda a: F.struct(u.alias("url"), host_of(a).alias("host"), F.regexp_extract(a, r":(\d+)\z", 1).alias("port"))))
    return let(parts, lambda x: let(error_of(x), lambda e: F.struct(F.when(e.isNull(), made(x)).alias("origin"), e.alias("error"))))


def same_site(a: Column, b: Column) -> Column:
    """Equal domains, or either lies under the other."""
    return (a != "") & (b != "") & ((a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)))


def suffixes(domain: Column) -> Column:
    """The domain and all domains above it, longest first: a.b.c, b.c, c."""
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def host_in(domain: Column, listed: Sequence[str]) -> Column:
    """Domain is listed or lies under a listed one."""
    return F.arrays_overlap(suffixes(domain), F.array(*[F.lit(x) for x in listed])) if listed else F.lit(False)


def blob(url: Column) -> Column:
    """Path, query and fragment in small letters."""
    return F.lower(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""))


def domain_display_name(domain: Column) -> Column:
    """Words of a domain's main label: under two-part public suffixes of .jp the label before them."""
    parts = F.filter(F.split(clean_domain(domain), r"\."), lambda x: x != "")
    n = F.size(parts)
    # fixed values: second levels of .jp
    deep = (n >= 3) & (F.try_element_at(parts, F.lit(-1)) == "jp") & F.try_element_at(parts, F.lit(-2)).isin("co", "or", "ne", "ac", "go", "gr", "ed", "lg", "ad")
    label = F.when(deep, F.try_element_at(parts, F.lit(-3))).when(n >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(F.try_element_at(parts, F.lit(1)))
    words = F.filter(F.split(F.regexp_replace(label, r"[^a-zA-Z0-9]+", "-"), "-"), lambda x: x != "")
    return F.coalesce(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.right(w, F.length(w) - 1)))), " "), F.lit(""))


def path_priority(url: Column, preferred: Sequence[str] = tuple(PREFERRED_PATHS), other: int = 100) -> Column:
    """Place of a path among preferred patterns, smaller is earlier: 0 for the root, from 1 for the first pattern contained, else ``other``; 999 for null."""
    p = F.regexp_replace(F.lower(path(url)), r"/+\z", "")
    out = F.when(url.isNull(), 999).when(p == "", 0)
    for i, x in enumerate(preferred):
        out = out.when(F.contains(p, F.lit(x)), i + 1)
    return out.otherwise(other).cast("int")


def url_score(url: Column, preferred: Sequence[str], hosted: Sequence[str] = (".blogspot.", ".wordpress.com", ".tumblr.")) -> Column:
    """100 for an address with a preferred pattern, 50 for a host of its own with at most two path segments, else 10."""
    u = F.lower(url)
    own = (netloc(url) != "") & ~contains_any(u, hosted) & (F.size(F.split(path(url), "/")) <= 3)
    return F.when(contains_any(u, preferred), 100).when(F.coalesce(own, F.lit(False)), 50).otherwise(10).cast("int")


def process_priority(url: Column) -> list[Column]:
    """Four sort keys of the processing order: national domain, builder platform, business path, depth; smaller is earlier."""
    u = F.lower(url)
    dom, p = F.replace(netloc(u), F.lit("www."), F.lit("")), F.regexp_replace(path(u), r"/+\z", "")
    depth = F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
    return [
        F.when(dom.endswith(".jp"), -2).otherwise(2).cast("int"), F.when(contains_any(dom, JP_PLATFORMS[:11]), 1).otherwise(0).cast("int"),
        F.when(contains_any(p, BUSINESS_PATHS), -1).otherwise(0).cast("int"), depth.cast("int"),
    ]


def is_junk(url: Column) -> Column:
    """A file, an archive or list page, or an action page."""
    u = F.lower(url)
    ext = F.lit(False)
    for x in JUNK_EXTENSIONS:
        ext = ext | path(u).endswith(x)
    return F.coalesce(ext | contains_any(u, JUNK_PATHS), F.lit(True))


def is_foreign(url: Column) -> Column:
    """A foreign top-level domain that isn't a known national platform."""
    dom = F.replace(F.lower(netloc(url)), F.lit("www."), F.lit(""))
    tld = F.lit(False)
    for t in FOREIGN_TLDS:
        tld = tld | dom.endswith(t)
    return F.coalesce(~dom.endswith(".jp") & ~host_in(dom, JP_PLATFORMS) & tld, F.lit(False))


def national_signal(url: Column, signals: Sequence[str] = tuple(JP_SIGNALS)) -> Column:
    """Whether an address of a foreign domain looks national after all: a part of its host, a word, or percent-encoded Japanese in path or query."""
    u = F.lower(url)
    dom = F.replace(netloc(u), F.lit("www."), F.lit(""))
    host = dom.startswith("jp.") | F.contains(dom, F.lit(".jp.")) | F.contains(dom, F.lit("japan"))
    return F.coalesce(host | contains_any(u, signals) | F.concat(path(u), F.lit("?"), query(u)).rlike("%e[3-9]"), F.lit(False))


#: What a domain may consist of: labels of letters, digits and inner hyphens.
DOMAIN = r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+$"


def strict_domain(value: Column) -> Column:
    """A bare domain like ``clean_domain``, but only if all its labels are well formed; else ''."""
    return let(clean_domain(value), lambda d: F.when(d.rlike(DOMAIN), d).otherwise(""))


def same_host(a: Column, b: Column) -> Column:
    """Equal hosts of two addresses, ports and users aside; false where either has none."""
    host = lambda u: F.regexp_replace(F.regexp_replace(F.lower(netloc(u)), r"^.*@", ""), r":\d*\z", "")
    return F.coalesce((host(a) != "") & (host(a) == host(b)), F.lit(False))


def lead_slug(value: Column, size: int = 56) -> Column:
    """Identifier text: lf- and the words (letters, marks, numbers and _; format characters separate) of a value, at most ``size`` letters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(value)), r"[^\p{L}\p{M}\p{N}_]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("lf-"), F.regexp_replace(F.substring(s, 1, size), "-+$", ""))


def lead_id(domain: Column, name: Column, row: Column) -> Column:
    """Identifier of a lead: the slug of its domain; else of its name with the row's number; else the number alone."""
    number = F.concat(F.lit("-r"), F.lpad(row.cast("string"), 5, "0"))
    number = F.when(F.length(row.cast("string")) > 5, F.concat(F.lit("-r"), row.cast("string"))).otherwise(number)
    by_domain, by_name = lead_slug(F.replace(F.coalesce(domain, F.lit("")), F.lit("."), F.lit("-"))), lead_slug(F.coalesce(name, F.lit("")), 40)
    return F.when(by_domain != "lf-", by_domain).when(by_name != "lf-", F.concat(by_name, number)).otherwise(F.concat(F.lit("lf-unknown"), number))
