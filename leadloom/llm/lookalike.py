"""Problem 6: one consistent form for texts that look the same.

Two results are kept apart. The *form* is the text itself in consistent writing: width
forms, styled letters, ligatures, glyph variants and composition unified, spaces of one
kind, invisible characters removed; no letter becomes another one, so sound text stays
sound. The *look* goes on to replace look-alike letters, dashes and middle dots; it is
for comparison only: texts that look the same have equal looks.

A text is exploded to positioned code points; each point is joined with a broadcast
table that holds its decomposition and its look; combining marks are ordered by class
within their cluster; clusters are joined with the table of compositions, and form and
look are rebuilt. Decompositions follow from the Unicode data, look-alikes of other
alphabets from the public confusables data in the ICU library that Spark ships, so the
tables' size is fixed; what those leave out (letters that lose parts in shop signs,
ideographs like kana) is stated below.

Only distinct texts that hold a character which the tables could change are exploded
(a test that may only err on the side of exploding); all other texts are
their own form and look. Everything about one text is done in one partitioning by the text.

Defined results: null stays null; invisible-only and blank texts become ''; outer
spaces go, inner ones stay in number; letter case, accents and voicing marks stay.
Hangul syllables stay whole.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

# Letters that look like another letter; each line maps its first text to its second, letter by letter.
LETTERS = [
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυχγκ", "ABEZHIKMNOPTYXaivopuxyk"),  # Greek
    ("АВЕЅІЈКМНОРСТУХԌаеіјорсухѕһԁԛԝ", "ABESIJKMHOPCTYXGaeijopcyxshdqw"),  # Cyrillic
    ("ԱՕՍօոսցհ", "UOUonugh"),  # Armenian
    ("ıɑɡⅼ∣ꓲꓳ〜∼", "iagl|IO~~"),  # other letters and signs
    ("口卜夕一工八力二へべぺりㇸ巛⼮", "ロトターエハカニヘベペリヘ川川"),  # ideographs and hiragana like katakana
    ("⻄⻘⻑⻁⻆⻝⻤⻩⻫⻯⻨⻲⺠⺟⺣⻌⻏⻖⻭⻰⻳", "西青長虎角食鬼黄斉竜麦亀民母火辶阝阝歯龍亀"),  # radicals without decomposition
]
DASHES = "‐‑‒–—―−⁃﹘﹣－─━⸺⸻˗"
DOTS = "·‧•∙⋅・･᛫⸱ꞏ"
#: Invisible characters beside the format characters (Cf), variation selectors and controls.
HIDDEN = "͏ᅟᅠ឴឵⠀ㅤﾠ᠋᠌᠍᠎᠏"


def visible(ch: str) -> bool:
    """Whether a character draws anything or is a space."""
    n = ord(ch)
    return not (unicodedata.category(ch) in ("Cf", "Cc") and ch not in "\t\n\r\x0b\x0c\x85") and ch not in HIDDEN and not (0xFE00 <= n < 0xFE10 or 0xE0100 <= n < 0xE01F0)


#: Alphabets whose letters are looked up among the public confusables: IPA and phonetic letters, Greek, Cyrillic, Armenian, Cherokee, Coptic, Lisu.
ALPHABETS = [(0x250, 0x2AF), (0x370, 0x58F), (0x13A0, 0x13F5), (0x1D00, 0x1D7F), (0x2C80, 0x2CF3), (0xA4D0, 0xA4F7)]


@functools.lru_cache(maxsize=1)
def _confusables(jvm: object) -> tuple[tuple[str, str], ...]:
    checker = getattr(jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    basic = {}
    for c in map(chr, (*range(0x41, 0x5B), *range(0x61, 0x7B))):
        basic[unicodedata.category(c), checker.getSkeleton(0, c)] = c
    out = []
    for low, high in ALPHABETS:
        for c in map(chr, range(low, high + 1)):
            if unicodedata.category(c) in ("Lu", "Ll", "Lo") and unicodedata.normalize("NFKD", c) == c:
                case = "Lu" if unicodedata.category(c) == "Lo" else unicodedata.category(c)
                if like := basic.get((case, checker.getSkeleton(0, c))):
                    out.append((c, like))
    return tuple(out)


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters of other alphabets that the public confusables data equate with a Latin letter of the same case."""
    return dict(_confusables(spark._jvm))


def points(alike: dict[str, str] | None = None) -> dict[str, str]:
    """What each code point becomes before marks are ordered, for all that change; with ``alike`` look-alikes are replaced too."""
    alike = alike or {}
    out = {"゛": "゙", "゜": "゚"}
    for n in range(sys.maxunicode + 1):
        ch = chr(n)
        if 0xD800 <= n < 0xE000 or 0xAC00 <= n < 0xD7A4 or ch in out or unicodedata.category(ch) == "Cn" and not 0xE0100 <= n < 0xE01F0:
            continue
        if not visible(ch):
            out[ch] = ""
            continue
        parts = alike.get(ch) or unicodedata.normalize("NFKD", ch)
        parts = "".join(" " if x.isspace() else alike.get(x, x) for x in parts if visible(x))
        if parts != ch:
            out[ch] = parts
    return out


@functools.lru_cache(maxsize=1)
def stated_alike() -> dict[str, str]:
    """The look-alikes stated above."""
    return {a: b for left, right in LETTERS for a, b in zip(left, right)} | dict.fromkeys(DASHES, "-") | dict.fromkeys(DOTS, "・")


def looks(spark: SparkSession) -> dict[str, str]:
    """What each code point looks like."""
    return points(confusables(spark) | stated_alike())


def compositions(changed: dict[str, str]) -> dict[str, str]:
    """Composed letter of each decomposed cluster."""
    return {parts: ch for ch, parts in changed.items() if len(parts) > 1 and unicodedata.normalize("NFC", parts) == ch}


#: Ranges that hold most letters in use: ASCII, Latin letters, kana, unified ideographs.
COMMON = [(0x20, 0x7E), (0xC0, 0x17F), (0x3041, 0x3096), (0x30A1, 0x30FC), (0x4E00, 0x9FFF)]


def changing(changed: dict[str, str]) -> str:
    """A regular expression that finds every text that may not be its own form: one with a point outside the common ranges, or in them one that changes (a composed letter that comes together again doesn't count)."""
    moved = changed.keys() - set(compositions(changed).values())
    spans, start = [], None
    for low, high in COMMON:
        for n in range(low, high + 2):
            if n <= high and chr(n) not in moved:
                start = n if start is None else start
            elif start is not None:
                spans.append(f"\\x{{{start:x}}}-\\x{{{n - 1:x}}}")
                start = None
    return "[^" + "".join(spans) + "]|^ | $"


def forms(texts: DataFrame, only_look: bool = False) -> DataFrame:
    """``digest``, ``form`` and ``look`` of each distinct text that may change; ``texts`` has the columns ``digest`` (of the text, which stands for it, as each code point becomes a row) and ``text``. With ``only_look`` the form is not made (null)."""
    spark = texts.sparkSession
    safe, look = points(), looks(spark)
    rows = [(ch, safe.get(ch, ch), look.get(ch, ch)) for ch in safe.keys() | look.keys()]
    to = F.broadcast(spark.createDataFrame(rows, "ch string, form string, look string"))
    classes = F.broadcast(spark.createDataFrame([(chr(n), unicodedata.combining(chr(n))) for n in range(sys.maxunicode + 1) if unicodedata.combining(chr(n))], "ch string, ccc int"))
    whole = spark.createDataFrame(list(compositions(safe).items()), "cluster_text string, composed string")
    exploded = texts.dropDuplicates(["digest"]).repartition("digest").select("digest", F.posexplode(F.split("text", "")).alias("pos", "ch"))
    made = [F.struct(F.lit(True).alias("looks"), F.coalesce("look", "ch").alias("parts"))]
    both = F.array(*made, *([] if only_look else [F.struct(F.lit(False).alias("looks"), F.coalesce("form", "ch").alias("parts"))]))
    mapped = exploded.join(to, "ch", "left").select("digest", "pos", F.inline(both)).select("digest", "looks", "pos", F.posexplode(F.split("parts", "")).alias("sub", "ch")).where("ch <> ''")
    classed = mapped.join(classes, "ch", "left").fillna({"ccc": 0})
    order = Window.partitionBy("digest", "looks").orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clusters = classed.withColumn("cluster", F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(order)).groupBy("digest", "looks", "cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ccc", "pos", "sub", "ch"))), lambda x: x["ch"]).alias("chars")
    )
    clusters = clusters.withColumn("cluster_text", F.array_join("chars", "")).withColumn("head", F.when(F.size("chars") > 2, F.array_join(F.slice("chars", 1, 2), "")))
    heads = whole.toDF("head", "head_composed")
    composed = clusters.join(F.broadcast(whole), "cluster_text", "left").join(F.broadcast(heads), "head", "left")
    best = F.coalesce("composed", F.concat("head_composed", F.array_join(F.expr("slice(chars, 3, size(chars))"), "")), "cluster_text")
    of = lambda looks, name: F.trim(F.array_join(F.transform(F.filter("parts", lambda x: x["looks"] == F.lit(looks)), lambda x: x["part"]), "")).alias(name)
    rebuilt = composed.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("looks", "cluster", best.alias("part")))).alias("parts"))
    return rebuilt.select("digest", F.lit(None).cast("string").alias("form") if only_look else of(False, "form"), of(True, "look"))


def consistent(rows: DataFrame, key: str, columns: list[str], only_look: bool = False) -> DataFrame:
    """``key``, ``raw`` (digest of the columns as they are), the form of each of ``columns`` under its own name and its look under that name with ``_look``; with ``only_look`` the forms are of no use."""
    pattern = changing(looks(rows.sparkSession))
    raw = F.unhex(F.md5(F.to_json(F.struct(*columns))))
    moves = lambda c: F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    moving = F.lit(False)
    for c in columns:
        moving = moving | moves(c)
    marked = rows.select(F.col(key), raw.alias("raw"), *columns, moving.alias("moving"))
    still = marked.where(~F.col("moving")).select(key, "raw", *columns, *[F.col(c).alias(f"{c}_look") for c in columns])
    each = marked.where("moving").select(key, "raw", F.posexplode(F.array(*columns)).alias("at", "text"))
    needed = each.where(F.col("text").rlike(pattern)).withColumn("digest", F.unhex(F.md5("text")))
    made = cut(forms(needed.select("digest", "text"), only_look))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    changed = needed.drop("text").join(made, "digest", "left").select(key, "raw", "at", blank("form"), blank("look"))
    kept = each.where(F.coalesce(~F.col("text").rlike(pattern), F.lit(True))).select(key, "raw", "at", F.col("text").alias("form"), F.col("text").alias("look"))
    # repeated rows give repeated values; they come back as one row with their number
    at = lambda of, name: [F.max(F.when(F.col("at") == i, F.col(of))).alias(name(c)) for i, c in enumerate(columns)]
    wide = changed.unionAll(kept).groupBy(key, "raw").agg(*at("form", lambda c: c), *at("look", lambda c: f"{c}_look"), F.sum(F.when(F.col("at") == 0, 1)).alias("times"))
    again = wide.select(key, "raw", *columns, *[f"{c}_look" for c in columns], F.explode(F.expr("array_repeat(1, cast(times as int))")).alias("one")).drop("one")
    return still.unionAll(again)


def alike_classes(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose ``columns`` are all filled and look like those of another row with other strings: ``key``, ``class_id`` (the smallest key of the class), ``n_links`` (rows of the class in another writing) and the ``raw`` digest of its own writing."""
    filled = " and ".join(f"`{c}` is not null and `{c}` <> ''" for c in columns)
    made = consistent(rows.where(filled), key, columns, only_look=True).where(" and ".join(f"`{c}_look` <> ''" for c in columns))
    look = F.unhex(F.md5(F.to_json(F.struct(*[F.col(f"{c}_look") for c in columns]))))
    keyed = cut(made.select(F.col(key), look.alias("look"), "raw"))
    # counted by writing first: no class is gathered, and groups of one writing end here, however many copies they hold
    writings = keyed.groupBy("look", "raw").agg(F.count("*").alias("n"), F.min(key).alias("low"))
    classes = writings.groupBy("look").agg(F.sum("n").alias("size"), F.min("low").alias("class_id"), F.count("*").alias("writings")).where("writings > 1")
    linked = writings.join(classes, "look").select("look", "raw", "class_id", (F.col("size") - F.col("n")).alias("n_links"))
    return keyed.join(linked, ["look", "raw"]).select(key, "class_id", "n_links", "raw")


def alike_pairs(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Pairs of rows whose ``columns`` are all filled and look the same, but aren't all the same strings: the classes as an asked-for list of pairs."""
    kept = alike_classes(rows, key, columns).select(F.col(key).alias("id"), "class_id", "raw")
    a, b = kept.alias("a"), kept.alias("b")
    pairs = a.join(b, F.expr("a.class_id = b.class_id and a.raw <> b.raw and a.id < b.id"))
    return pairs.select(F.col("a.id").alias(f"{key}_a"), F.col("b.id").alias(f"{key}_b"))
