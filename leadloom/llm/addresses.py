"""Problem 3: the same postal address written differently.

An address is parsed into components: administrative area, town (a direction, two
elements), block numbers and house number; building, floor, room and postal code are
left aside. Locale dictionaries expand old and mistaken ideographs, number words, and
the Latin readings of the elements, so that every writing of a town has one canonical
name. Pages are joined on hierarchical keys: first town with its three numbers, then
the area by explicit rules. A component that is missing agrees with any value as long
as the key is known in one area only; otherwise it agrees only with what it names.

A town that isn't made of known elements is mended where exactly one of the usual slips
(a doubled or swapped letter, a left-out or mistaken one) leads to a town that is; an
existing town is never changed into a similar one.

The dictionaries stated here are those of one region. Names beyond them are kept as they
are spelled, and their other writings are learnt from the pages: where a page gives one
house in two writings (equal numbers in its two fields), or where addresses give equal
numbers with one postal code, the names before the numbers are spellings of one town,
and the one with the most such evidence becomes the town's name for all pages (``learnt``). So a town that no dictionary holds is still found
under its Latin and its mistaken spellings.

Defined results: null and blank fields and text without a town and numbers are no
address; a page pairs with no copy of its own id; pages with equal fields pair like
any others.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# Elements of town names with their readings.
DIRECTIONS = dict(zip("東西南北上中下新", "higashi nishi minami kita kami naka shimo shin".split()))
FIRST = dict(zip(
    "絹豆琴鯉馬菱黒雪虹宝砂鮎弓石鹿梅麦鼓白鉄桐星竹岩亀緑錦菊松柳鏡銀桜金熊杉青米鶴雨笛湯藤鷹粟霧赤玉矢塩",
    ("kinu mame koto koi uma hishi kuro yuki niji takara suna ayu yumi ishi shika ume mugi tsuzumi shiro tetsu kiri hoshi take iwa kame midori nishiki kiku "
     "matsu yanagi kagami gin sakura kane kuma sugi ao kome tsuru ame fue yu fuji taka awa kirisa aka tama yata shio").split(),
))
SECOND = dict(zip(
    "原丸池島倉江崎堀津瀬門畑坂沢淵宮浜峰野森浦谷塚寺橋市岡里林辻",
    "hara maru ike jima kura e saki hori tsu se kado hata zaka zawa fuchi miya hama mine no mori ura tani zuka dera bashi ichi oka sato bayashi tsuji".split(),
))
#: Old forms and ideographs mistaken for another one.
VARIANTS = str.maketrans("濱澤櫻鐵鹽麥巌巖嶋嶌靑靏靍籐枩麁畠﨑碕峯黑寶龜綠", "浜沢桜鉄塩麦岩岩島島青鶴鶴藤松鹿畑崎崎峰黒宝亀緑")
MISTAKEN = str.maketrans("捕僑理阪容蒼官家頼岳秦源皇右應沙彬掬根地", "浦橋里坂谷倉宮塚瀬岡森原星石鷹砂杉菊銀池")
#: Administrative areas: city, its wards, each with its reading.
CITIES = {"青白": "aojiro", "神晴": "kamiharu", "福羽": "fukuha", "山都": "yamato", "大風": "okaze", "長里": "nagasato"}
WARDS = {
    "西木": ("nishiki", "神晴"), "中海": ("nakaumi", "神晴"), "北港": ("kitaminato", "神晴"), "青田": ("aota", "福羽"), "朝凪": ("asanagi", "福羽"),
    "城坂": ("shirosaka", "山都"), "南星": ("nansei", "山都"), "立浜": ("tatehama", "大風"),
}
DIGITS = {c: n for n, c in enumerate("〇一二三四五六七八九")}
BUILDING = re.compile(r"kaikan|bldg|building|corpo|mansion|heights|hts|plaza|residence|court|house|apart|tower|floor|room|\bms\b", re.I)


def number(words: str) -> str:
    """Number words up to the thousands, or digits read one by one."""
    if not re.search("[十百千]", words):
        return str(int("".join(str(DIGITS[c]) for c in words)))
    total, digit = 0, 0
    for c in words:
        if c in DIGITS:
            digit = DIGITS[c]
        else:
            total, digit = total + (digit or 1) * {"十": 10, "百": 100, "千": 1000}[c], 0
    return str(total + digit)


@functools.lru_cache(maxsize=1)
def latin_towns() -> tuple[dict[str, str], dict[str, set[str]]]:
    """Canonical town of each Latin name, and of each Latin name with one letter left out."""
    exact = {}
    for d, dr in [("", ""), *DIRECTIONS.items()]:
        for a, ar in FIRST.items():
            for b, br in SECOND.items():
                exact.setdefault(dr + ar + br, d + a + b)
    short: dict[str, set[str]] = {}
    for name in exact:
        for i in range(len(name)):
            short.setdefault(name[:i] + name[i + 1 :], set()).add(name)
    return exact, short


def slips(name: str) -> tuple[set[str], set[str]]:
    """What a name may have been before a slip: the name with a doubled letter undone or neighbours swapped back, and the name as one with a letter left out."""
    undone = {name[:i] + name[i + 1 :] for i in range(1, len(name)) if name[i] == name[i - 1]}
    undone |= {name[:i] + name[i + 1] + name[i] + name[i + 2 :] for i in range(len(name) - 1)}
    return undone - {name}, {name}


@functools.lru_cache(maxsize=50_000)
def latin_town(name: str) -> tuple[str, ...]:
    """Canonical towns that a Latin name in small letters without separators may stand for."""
    exact, short = latin_towns()
    if name in exact:
        return (exact[name],)
    undone, left_out = slips(name)
    near = {exact[x] for x in undone if x in exact} | {exact[t] for x in left_out for t in short.get(x, ())}
    return tuple(sorted(near))


# Names of buildings with their Latin spelling, and kinds of buildings.
BASES = dict(zip(
    "オリオン グリーン ノース メイプル セントラル レガート シエル パール アーク ハーバー ベルデ ミナモ ソレイユ コスモ サンリバー ルミエ テラス カナリア フローラ プリマ".split(),
    "orion green north maple central legato ciel pearl arc harbor verde minamo soleil kosumo sunriver lumie terrace canaria flora prima".split(),
))
KINDS = {"会館": "kaikan", "マンション": "mansion", "ms": "mansion", "ハイツ": "heights", "hts": "heights", "heights": "heights", "ビルヂング": "bldg", "ビルディング": "bldg", "ビルジング": "bldg", "ビル": "bldg",
         "bldg": "bldg", "building": "bldg", "プラザ": "plaza", "plaza": "plaza", "コーポラス": "corpo", "コーポ": "corpo", "corpo": "corpo", "corporas": "corpo", "kaikan": "kaikan", "mansion": "mansion"}
KIND = "|".join(sorted(KINDS, key=len, reverse=True))
NAMED = re.compile(rf"([ァ-ヴー]{{2,10}}?|[a-z][a-z-]{{2,12}}?)[ -]*({KIND})(?![a-zァ-ヴ])", re.I)


def postal_of(address: str) -> str | None:
    """The seven digits of the postal code of an address."""
    m = POSTAL.search(unicodedata.normalize("NFKC", address))
    return re.sub(r"\D", "", m[0]) if m else None


def building_of(text: str) -> str | None:
    """Canonical building of a text: name without long-vowel marks or in its Latin spelling, and kind."""
    if not (m := NAMED.search(text.lower())):
        return None
    known = {k.replace("ー", ""): v for k, v in BASES.items()} | {v: v for v in BASES.values()}
    base = m[1].replace("ー", "").replace("-", "")
    if base not in known:
        near = {v for k, v in known.items() if len(k) > 2 and (len(k) == len(base) and sum(a != b for a, b in zip(k, base)) == 1 or k in slips(base)[0] or any(base == k[:i] + k[i + 1 :] for i in range(len(k))))}
        base = near.pop() if len(near) == 1 else base
    return f"{known.get(base, base)} {KINDS[m[2].lower()]}"


TOWN = re.compile("([" + "".join(DIRECTIONS) + "]?)([" + "".join(FIRST) + "])[ノの之ケヶ]?([" + "".join(SECOND) + "])(?:町|丁)?$")


def town_at_end(text: str) -> str | None:
    """Canonical town with which a text in ideographs ends."""
    text = re.sub(r"\s+", "", text).translate(VARIANTS)
    text = text[:-5] + re.sub(r"([一-鿿])\1", r"\1", text[-5:])
    for now in (text, text.translate(MISTAKEN)):
        if m := TOWN.search(now):
            return m[1] + m[2] + m[3]
    tail = re.sub("[町丁]$", "", text.translate(MISTAKEN))
    base, end = tail[:-4], tail[-4:]
    found = {m[1] + m[2] + m[3] for x in slips(end)[0] if (m := TOWN.search(base + x))}
    # a swap may pull a letter of the area in; the longest town is the whole one
    longest = max(map(len, found), default=0)
    found = {t for t in found if len(t) == longest}
    return found.pop() if len(found) == 1 else None


WORDS = "〇一二三四五六七八九十百千"
NUMBERS = re.compile(r"(\d+)\s*(?:丁目|[-の])\s*(\d+)(?:\s*(?:番地の|番地|番の|番|[-の])\s*(\d+))?")
LATIN_NUMBERS = re.compile(r"(?<![\d-])(\d+)\s*(?:-?\s*cho?me?\s*[-, ]?\s*|-)(\d+)(?:\s*-\s*(\d+))?", re.I)
POSTAL = re.compile(r"〒\s*\d{3}[- ]?\d{4}|(?<![\d-])\d{3}-\d{4}(?![\d-])|(?<![\d-])\d{7}(?![\d-])")


AREA_PARTS = (
    {r + x: (w, c) for w, (r, c) in WARDS.items() for x in ("", "ku", "ward")} | {r + x: (None, c) for c, r in CITIES.items() for x in ("", "shi", "city")}
    | dict.fromkeys(["suihama", "heizan", "japan", "suihamaken", "heizanken", "suihamapref", "heizanpref"], (None, None))
)


@functools.lru_cache(maxsize=10_000)
def near_area(part: str) -> bool:
    """Whether a Latin part is an area's name with a slip."""
    return any(x in AREA_PARTS for x in slips(part)[0]) or any(part == a[:i] + a[i + 1 :] for a in AREA_PARTS for i in range(len(a)))


def parse(address: str | None) -> tuple[tuple[str, ...], str, str | None, str | None, str | None, str | None] | None:
    """Possible towns (mostly one; of several the last is the name as it is spelled, like that of a town of other elements), block numbers, house number, building, ward and city of an address; None if it names neither house nor building."""
    if not address:
        return None
    text = unicodedata.normalize("NFKC", address)
    text = re.sub(r"(?<=[\d\s" + WORDS + r"])[ー‐‑‒–—―−－~〜](?=[\d\s" + WORDS + "])|[‐‑‒–—―−]", "-", text)
    text = POSTAL.sub(" ", text)
    towns: tuple[str, ...] = ()
    ward = city = None
    if re.search("[一-鿿]", text):
        text = re.sub(f"[{WORDS}]+(?=\\s*(?:丁目|番|号|の\\s*[{WORDS}\\d]))|(?<=の)[{WORDS}]+|(?<=番地)[{WORDS}]+|(?<=-)[{WORDS}]+|[{WORDS}]+(?=-)", lambda m: number(m[0]), text)
        for m in NUMBERS.finditer(text):
            town = town_at_end(text[: m.start()]) or other_town(text[: m.start()])
            if town:
                towns = (town,)
                before = re.sub(r"\s+", "", text[: m.start()]).translate(VARIANTS)[: -len(town.lstrip("?"))]
                ward = next((w for w in WARDS if w in before), None)
                city = next((c for c in CITIES if c in before), None) or (WARDS[ward][1] if ward else None)
                if town.startswith("?") and not ward and not city:  # another region: areas as they are written
                    ward, city = ((m2[1] if (m2 := re.search(f"([^都道府県市区郡]{{1,6}}){kind}", before)) else None) for kind in "区市")
                break
    else:
        low = text.lower()
        if m := LATIN_NUMBERS.search(low):
            rest = low[: m.start()] + "," + low[m.end() :]
            parts = [x for p in re.split(r"[,\n;()]|\d+", rest) if not BUILDING.search(p) and (x := re.sub("[^a-z]", "", p))]
            areas = [AREA_PARTS[p] for p in parts if p in AREA_PARTS]
            ward = next((w for w, _ in areas if w), None)
            city = next((c for _, c in areas if c), None)
            others = [p for p in parts if p not in AREA_PARTS and len(p) > 2]
            exact = latin_towns()[0]
            name, towns = next(((p, (exact[p],)) for p in others if p in exact), None) or next(((p, t) for p in others if not near_area(p) and (t := latin_town(p))), ("", ()))
            if len(towns) > 1:
                towns = (*towns, "?" + name)
            elif not towns and all(re.fullmatch("[1-9][0-9]{0,2}", n) for n in m.groups() if n):  # no telephone number or date
                beside = [re.split(r"[,\n;()]|\d+", low[: m.start()])[-1], re.split(r"[,\n;()]|\d+", low[m.end() :])[0]]
                names = [x for x in (re.sub("[^a-z]", "", p) for p in beside) if x in others] + others
                towns = next((("?" + p,) for p in names if not near_area(p)), ())
    if not towns:
        return None
    building = None if m[3] else building_of(text)
    if not m[3] and not building:
        return None
    return towns, f"{int(m[1])}-{int(m[2])}", str(int(m[3])) if m[3] else None, building or building_of(text), ward, city


def other_town(text: str) -> str | None:
    """The name before the numbers, for towns made of other elements."""
    m = re.search(r"([^\s\d、。,()（）:：]+)\s*$", text.translate(VARIANTS))
    # after the last area that something follows: 青白市南鹿市 is the town 南鹿市
    name = re.sub("^.*[都道府県市区郡](?=.)", "", m[1])[-8:] if m else ""
    return "?" + name if re.search("[一-鿿ぁ-ヿ]", name) and not re.fullmatch("[都道府県市区郡]", name) else None


SCHEMA = "page_id bigint, town string, choices int, block string, house string, building string, ward string, city string, spelling string, postal string"


def places(pages: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each field that holds an address and each town it may stand for (``choices`` of them), with the ``spelling`` of a doubtful one."""
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            ids = b.column(key).to_pylist()
            for f in fields:
                for i, address in zip(ids, b.column(f).to_pylist()):
                    if i is not None and (got := parse(address)):
                        towns, spelling = (got[0][:-1], got[0][-1]) if len(got[0]) > 1 else (got[0], None)
                        rows += [(i, town, len(towns), *got[1:], spelling, postal_of(address)) for town in towns]
            types = [pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return pages.select(key, *fields).mapInArrow(run, SCHEMA)


def learnt(each: DataFrame, least_share: float = 0.6) -> DataFrame:
    """``spelling, name``: for town names beyond the dictionaries the name that the same house has on the same pages in another writing.

    The name is in the dictionaries or in ideographs; it has at least ``least_share`` of the spelling's
    evidence, and, if it is itself beyond the dictionaries, more pages than an ideographic spelling.
    """
    sure = each.where("house is not null and choices = 1 and spelling is null").select("page_id", "town", "block", "house", "postal").distinct()
    odd, plain = F.col("town").startswith("?"), F.col("name").rlike(r"^\?[a-z]+$")
    support = sure.groupBy("town").agg(F.count("*").alias("n"))
    # names of one house by its postal code are few; they are counted before they meet
    by_code = sure.where("postal is not null").groupBy("postal", "block", "house", "town").agg(F.count("*").alias("n"))
    pair = lambda rows, by, n: (
        rows.where(odd).withColumnRenamed("town", "spelling").drop("n").join(rows.withColumnRenamed("town", "name").where(~plain), by).where("spelling <> name").select("spelling", "name", n.alias("n"))
    )
    seen = pair(sure.drop("postal").distinct(), ["page_id", "block", "house"], F.lit(1)).unionAll(pair(by_code, ["postal", "block", "house"], F.col("n"))).groupBy("spelling", "name").agg(F.sum("n").alias("n"))
    total = Window.partitionBy("spelling")
    best = seen.withColumn("all", F.sum("n").over(total)).withColumn("place", F.row_number().over(total.orderBy(F.desc("n"), "name"))).where("place = 1")
    best = best.where(F.col("n") >= least_share * F.col("all")).select("spelling", "name")
    sizes = best.join(support.select(F.col("town").alias("spelling"), F.col("n").alias("n_spelling")), "spelling").join(support.select(F.col("town").alias("name"), F.col("n").alias("n_name")), "name")
    latin = F.col("spelling").rlike(r"^\?[a-z]+$")
    return sizes.where(latin | ~F.col("name").startswith("?") | (F.col("n_name") > F.col("n_spelling"))).select("spelling", "name")


def located(pages: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``page_id, place, area``: the places of each page that shares one with another page.

    Rules for missing components: an address without house number, but with a building, lies
    at the one house of its block at which that building is known, else at the building
    itself; one whose town is in doubt lies in that of the possible towns in which its
    numbers are known, of several in that of the same ward, else city, and never in another
    area; if its numbers are known in none, in a town of its own spelling; area as
    described above.
    """
    found = cut(places(pages, key, fields).distinct())
    # names beyond the dictionaries are few: the others never meet this join
    odd = F.col("town").startswith("?") & (F.col("choices") == 1) & F.col("spelling").isNull()
    names = learnt(found).withColumnRenamed("spelling", "town")
    each = cut(found.where(~odd).unionByName(found.where(odd).join(names, "town", "left").withColumn("town", F.coalesce("name", "town")).drop("name")).drop("postal").distinct())
    built = each.where("house is not null and building is not null and choices = 1").groupBy("town", "block", "building")
    houses = built.agg(F.min("house").alias("at"), F.max("house").alias("last")).where("at = last").drop("last")
    # the place by the spelling of a doubtful town
    each = each.withColumn("own", F.when(F.col("spelling").isNotNull(), F.concat_ws(" ", "spelling", "block", F.coalesce("house", F.concat(F.lit("b:"), "building")))))
    partial = each.where("house is null").join(houses, ["town", "block", "building"], "left")
    whole = each.where("house is not null").select("page_id", "town", "own", "block", "house", "ward", "city")
    filled = partial.select("page_id", "town", "own", "block", F.coalesce("at", F.concat(F.lit("b:"), "building")).alias("house"), "ward", "city")
    every = whole.unionAll(filled).select("page_id", "own", F.concat_ws(" ", "town", "block", "house").alias("place"), "ward", "city")
    sure = every.where("own is null").drop("own")
    doubt = every.where("own is not null").withColumn("address", F.concat_ws("|", "own", F.coalesce("ward", F.lit("-")), F.coalesce("city", F.lit("-"))))
    same = lambda c: F.coalesce((F.col(c) == F.col(f"sure_{c}")).cast("int"), F.lit(0))
    other = lambda c: F.coalesce(F.col(c) != F.col(f"sure_{c}"), F.lit(False))
    met = doubt.join(sure.select("place", F.col("ward").alias("sure_ward"), F.col("city").alias("sure_city")).distinct(), "place").where(~other("ward") & ~other("city"))
    ranked = met.withColumn("fit", 2 * same("ward") + same("city")).withColumn("most", F.max("fit").over(Window.partitionBy("page_id", "address")))
    chosen = ranked.where("fit = most").select("page_id", "address", "place", "ward", "city")
    alone = doubt.join(chosen.select("page_id", "address").distinct(), ["page_id", "address"], "left_anti").select("page_id", F.col("own").alias("place"), "ward", "city")
    all_of = sure.unionAll(chosen.drop("address")).unionAll(alone).distinct()
    known = all_of.groupBy("place").agg(
        F.coalesce(F.min("ward") == F.max("ward"), F.lit(True)).alias("one_ward"), F.coalesce(F.min("city") == F.max("city"), F.lit(True)).alias("one_city"), F.min("page_id").alias("low"), F.max("page_id").alias("high")
    ).where("low < high")
    joined = all_of.join(known, "place")
    # one area at most: what is missing agrees; several: each stands for itself
    area = F.when(F.col("one_ward") & F.col("one_city"), F.lit("")).otherwise(F.concat_ws("/", F.coalesce("city", F.lit("-")), F.coalesce("ward", F.lit("-"))))
    return joined.select("page_id", "place", area.alias("area")).distinct()


def place_classes(pages: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``page_id, place, area, first_page_id, n_pages``: the membership of pages in places, with each place's smallest page and number of pages."""
    at = located(pages, key, fields)
    by = at.groupBy("place", "area").agg(F.min("page_id").alias("first_page_id"), F.count("*").alias("n_pages"))
    return at.join(by, ["place", "area"]).select("page_id", "place", "area", "first_page_id", "n_pages")


def same_place(pages: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Pairs of pages of which any address of one is the place of any address of the other."""
    at = located(pages, key, fields)
    a, b = at.alias("a"), at.alias("b")
    pairs = a.join(b, F.expr("a.place = b.place and a.area = b.area and a.page_id < b.page_id"))
    return pairs.select(F.col("a.page_id").alias("page_id_a"), F.col("b.page_id").alias("page_id_b")).distinct()
