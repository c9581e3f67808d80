"""Wrongly decoded text: every pair both ways, mixed spans, lost characters, sound names, edge cases."""

import pytest

from leadloom.llm import mojibake

TEXTS = ["ネイル・サロン花", "【人気】ヨガスタジオ 陽和めぐ", "Café Été", "要確認；店名を手動で確認"]


def garble(text, true, wrong):
    return mojibake.to_text(mojibake.to_bytes(text, true), wrong)


@pytest.mark.parametrize("true,wrong", [("utf-8", "sloppy_1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("cp932", "sloppy_1252"), ("euc_jp", "latin-1"), ("euc_jp", "sloppy_1252"), ("utf-8", "cp932"), ("utf-8", "gbk"), ("euc_jp", "cp932")])
def test_pairs(true, wrong):
    done = 0
    for t in TEXTS:
        if mojibake.to_bytes(t, true) and (bad := garble(t, true, wrong)):
            found, restored, how = mojibake.inspect(bad)
            assert found, (bad, true, wrong)
            assert restored in (t, None)
            done += restored == t
    single = wrong in ("sloppy_1252", "latin-1", "mac_roman")
    assert done >= (3 if single else 0)


def test_double_and_mixed():
    twice = garble(garble("写真館 はな", "utf-8", "sloppy_1252"), "utf-8", "sloppy_1252")
    assert mojibake.inspect(twice)[:2] == (True, "写真館 はな")
    assert mojibake.inspect("フィットネス " + garble("山都市", "utf-8", "latin-1"))[:2] == (True, "フィットネス 山都市")
    assert mojibake.inspect("Ni" + garble("ñ", "utf-8", "sloppy_1252") + "o")[:2] == (True, "Niño")
    assert mojibake.inspect("Зako Faoxзa")[:2] == (True, "Çako Faoxça")


def test_lost_characters_are_found_but_not_restored():
    for t in ("ル�チガニ 接骨院", "�ʐ^�ف"):
        assert mojibake.inspect(t)[:2] == (True, None)


SOUND = ["繧繝彩色アトリエ", "Ελένη Σαλόνι", "Привет Студия", "½プライス整体", "№1 リトミック", "µ-Lab", "〒マーク雑貨", "¿Qué Tal? 語学", "Œuvre & Æther", "SÃO Lorenço Nail", "Łódka Masaż", "Tiếng Việt Spa",
         "Café–Nail „Süß“", "ﾈｲﾙ&ｱｲ", "ｻﾛﾝ ﾐﾓｻﾞ", "ﾏｯｻｰｼﾞ ﾊｳｽ", "Salon店", "Ã la Carte", "©rea ヨガ", "?!サロン??", "蜷局ヨガ", "", None, "x" * 300_000, "花" * 50_000]


@pytest.mark.parametrize("text", SOUND)
def test_sound_text(text):
    assert mojibake.inspect(text) == (False, None, None)


def test_table(spark):
    bad = garble(TEXTS[0], "utf-8", "sloppy_1252")
    df = spark.createDataFrame([(1, bad, None, "x"), (2, "花", bad, "x"), (None, None, None, None)], "name_id bigint, a string, b string, field string")
    got = sorted(tuple(r) for r in mojibake.garbled_fields(df, "name_id", ["a", "b"]).collect())
    assert got == [(1, "a", bad, TEXTS[0], "utf-8/sloppy_1252"), (2, "b", bad, TEXTS[0], "utf-8/sloppy_1252")]
    assert mojibake.garbled_fields(df.limit(0), "name_id", ["a", "b"]).count() == 0


def shifts(text, escape=""):
    return text.encode("iso2022_jp").decode("ascii").replace("\x1b", escape)


@pytest.mark.parametrize("escape", ["", "\x1b"])
@pytest.mark.parametrize("text", [*[t for t in TEXTS if "é" not in t], "ジガメガテ美容室 | 羽瀬市のサロン", "Nori Rorael｜ご予約", "花", "夢〜路"])
def test_shifts_read_as_ascii(text, escape):
    assert mojibake.inspect(shifts(text, escape)) == (True, text, "iso2022_jp/ascii")


def test_shifts_beside_sound_and_other_garbled_text():
    assert mojibake.inspect("ネイ$B%k(B $B8w@c$9$m$Y(B") == (True, "ネイル 光雪すろべ", "iso2022_jp/ascii")
    assert mojibake.inspect("$B-j(B\x1b(J Hana")[:2] == (True, "㈱ Hana")
    assert mojibake.inspect("$@%5%m%s(J " + garble("写真館", "utf-8", "sloppy_1252")) == (True, "サロン 写真館", "iso2022_jp/ascii; utf-8/sloppy_1252")


def test_shifts_cut_off():
    for end in ("", "(", "\x1b", "\x1b("):
        assert mojibake.inspect("Riya $B%8%,%a" + end)[:2] == (True, "Riya ジガメ")
    assert mojibake.inspect("$B%8%,%")[:2] == (True, None)
    assert mojibake.inspect("$B%8%,%(B")[:2] == (True, None)
    assert mojibake.inspect("$B9b2;;T")[:2] == (True, "高音市")


@pytest.mark.parametrize("text", ["Pay $B", "$BIG SALE", "$BIGSALE", "$BASIC-PLAN!", "Salon (B1F)", "Nail $50(B)", "A$B.C(Beta)", "$@home", "f(x) $B(B", "$" * 1001, "$B" + "x" * 300_000])
def test_sound_ascii(text):
    assert mojibake.inspect(text) == (False, None, None)


def test_shifts_in_single_fields(spark):
    bad = shifts(TEXTS[0])
    df = spark.createDataFrame([(1, bad, "Hair"), (2, "Nail", bad)], "name_id bigint, a string, b string")
    got = sorted(tuple(r) for r in mojibake.garbled_fields(df, "name_id", ["a", "b"]).collect())
    assert got == [(1, "a", bad, TEXTS[0], "iso2022_jp/ascii"), (2, "b", bad, TEXTS[0], "iso2022_jp/ascii")]


@pytest.mark.parametrize("text,true,wrong", [("Привет мир", "utf-8", "sloppy_1252"), ("Größe", "utf-8", "cp850"), ("Größe", "utf-8", "cp437"), ("中文商店", "gbk", "latin-1"), ("Привет мир", "cp1251", "latin-1"), ("안녕하세요", "utf-8", "latin-1"), ("Ελένη", "utf-8", "mac_roman")])
def test_other_scripts(text, true, wrong):
    assert mojibake.inspect(garble(text, true, wrong))[:2] == (True, text)


def test_nothing_is_restored_where_several_encodings_make_sense():
    assert mojibake.inspect(garble("안녕하세요", "euc_kr", "latin-1"))[:2] == (True, None)
    assert mojibake.inspect(garble("美容室", "euc_jp", "latin-1"))[:2] == (True, None)
    assert mojibake.inspect("ネイル " + garble("美容室", "euc_jp", "latin-1"))[:2] == (True, "ネイル 美容室")


def test_any_number_of_layers():
    text = "写真館 はな"
    for _ in range(7):
        text = garble(text, "utf-8", "sloppy_1252")
        assert mojibake.inspect(text)[:2] == (True, "写真館 はな")


def test_look_alike_letters_are_no_garbling():
    assert mojibake.inspect("salonК café") == (False, None, None)
    assert mojibake.inspect("Espaсa")[:2] == (True, "España")


def test_long_texts_take_time_in_proportion():
    import time

    took = []
    for n in (2_000, 20_000):
        start = time.perf_counter()
        assert mojibake.inspect(garble("写真館 はな", "utf-8", "latin-1") * n)[:2] == (True, "写真館 はな" * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 40 * took[0]
