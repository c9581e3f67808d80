"""Look-alike text against a form computed with the standard library."""

import random
import unicodedata

from leadloom.llm import lookalike

COLUMNS = ["display_name", "store_name", "city"]
SCHEMA = "lead_id bigint, display_name string, store_name string, city string, form string, raw string, text string"
POINTS, LOOKS = lookalike.points(), lookalike.points(lookalike.stated_alike())


def form(text, points=LOOKS):
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(points.get(c, c) for c in text))).strip(" ")


def frame(spark, data):
    return spark.createDataFrame([(*d, "x", "y", "z") for d in data], SCHEMA)


def variants(r, text):
    out = []
    for c in text:
        out.append(r.choice([c, c, unicodedata.normalize("NFD", c), {"ロ": "口", "カ": "力", "a": "а", "o": "ο", "-": "‐", " ": "\u2009", "・": "·"}.get(c, c), c + r.choice(["", "\u200b", "\u00ad", "\ufe00"])]))
    return "".join(out)


def test_forms_and_pairs(spark):
    r = random.Random(3)
    names = ["サロン・ガロカ 花", "Café Nailo-a", "へべりピアノ", "ﾈｲﾙｶﾞ ﾊﾟ", "Ñandú 館", "Fiﬁ Ⅷ", "é\u0327x", "plain"]
    data = [(i, variants(r, n := r.choice(names)), variants(r, n), variants(r, "福羽市")) for i in range(120)]
    data += [(900, None, "a", "b"), (901, "", "a", "b"), (902, "\u200b", "a", "b"), (903, "a" * 50_000, "b", "c"), (904, "a" * 50_000 + "\u200b", "b", "c")] + [(905, "q", "q", "q")] * 3
    rows = lookalike.consistent(frame(spark, data), "lead_id", COLUMNS).collect()
    assert {r.lead_id: tuple(r[c + "_look"] for c in COLUMNS) for r in rows} == {i: tuple(x if x is None else form(x) for x in v) for i, *v in data}
    assert {r.lead_id: tuple(r[c] for c in COLUMNS) for r in rows} == {i: tuple(x if x is None else form(x, POINTS) for x in v) for i, *v in data}
    assert lookalike.consistent(frame(spark, data), "lead_id", COLUMNS).count() == len(data)
    got = {tuple(x) for x in lookalike.alike_pairs(frame(spark, data), "lead_id", COLUMNS).collect()}
    want = set()
    for a in data:
        for b in data:
            if a[0] < b[0] and a[1:] != b[1:] and None not in (*a, *b):
                fa, fb = [form(x) for x in a[1:]], [form(x) for x in b[1:]]
                if fa == fb and all(fa):
                    want.add((a[0], b[0]))
    assert got == want and len(want) > 100
    links, low = {}, {}
    for a, b in want:
        for x in (a, b):
            links[x] = links.get(x, 0) + 1
            low[x] = min(low.get(x, a), a)
    classes = lookalike.alike_classes(frame(spark, data), "lead_id", COLUMNS).collect()
    assert {r.lead_id: r.n_links for r in classes} == links
    assert all(r.class_id <= low[r.lead_id] for r in classes)


def test_what_stays_different(spark):
    data = [(i, x, "s", "c") for i, x in enumerate(["カナ", "ガナ", "hana", "Hana", "Café", "Cafe", "花", "華", "サロン", "サロン*"])]
    assert lookalike.alike_pairs(frame(spark, data), "lead_id", COLUMNS).count() == 0


def test_empty(spark):
    assert lookalike.alike_pairs(frame(spark, []), "lead_id", COLUMNS).count() == 0


def test_sound_text_keeps_its_letters(spark):
    data = [(1, "一力工業 二八そば へる", "Ｓａｌｏｎ　ｶﾞ", "Сafe\u0301\u200b"), (2, "ѡork", "Ꭺ", "c")]
    got = {r.lead_id: r for r in lookalike.consistent(frame(spark, data), "lead_id", COLUMNS).collect()}
    assert tuple(got[1][c] for c in COLUMNS) == ("一力工業 二八そば へる", "Salon ガ", "Сafé")
    assert got[1].city_look == "Café" and got[1].display_name_look != got[1].display_name
    assert (got[2].display_name_look, got[2].store_name_look) == ("work", "A")  # public confusables
