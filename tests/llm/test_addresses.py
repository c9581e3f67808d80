"""Places: writings that are one place, neighbours that are not, slips, missing parts, empty input."""

import pytest

from leadloom.llm import addresses

SAME = [
    "〒005-0497\n翠浜県長里市 東霧峰6-71-1", "長里市東霧峰六丁目七十一番一号 パールビル 402号", "東霧峰６丁目７１番地の１", "Higashi-Kirisamine 6-71-1, Nagasato-shi", "6 Chome-71-1 HigashiKirisamine, Nagasato City, Japan 005-0497",
    "6-chome 71-1, higashi-kirisamine, nagasato, suihama", "長里市東霧霧峰6の71の1", "長里市東峰霧 6－71－1", "長里市東霧ノ峰町6-71-1-302",
]


@pytest.mark.parametrize("text", SAME)
def test_writings_of_one_place(text):
    got = addresses.parse(text)
    assert got and got[0] == ("東霧峰",) and got[1:3] == ("6-71", "1")


@pytest.mark.parametrize("text", ["", None, "翠浜県", "福羽市青田区", "駐車場あり", "駅から徒歩5分", "お問い合わせください", "-", "03-1234-5678"])
def test_no_address(text):
    assert addresses.parse(text) is None


def test_neighbours_and_similar_towns_stay_apart():
    near = ["長里市東霧峰6-71-2", "長里市東霧峰6-72-1", "長里市西霧峰6-71-1", "長里市東桐峰6-71-1", "長里市東霧森6-71-1"]
    assert len({addresses.parse(x)[:3] for x in [*near, SAME[0]]}) == 6


def test_old_forms_numbers_and_areas():
    assert addresses.parse("碧山県大風市立浜区西鹽宮十一丁目二〇番三号")[:3] == (("西塩宮",), "11-20", "3")
    assert addresses.parse("神晴中海区南岩谷7-24-1")[4:] == ("中海", "神晴")
    assert addresses.number("二十一") == "21" and addresses.number("百五") == "105" and addresses.number("二〇") == "20"


SCHEMA = "page_id bigint, address string, contact_page_address string, town string, city string"


def pairs(spark, data):
    df = spark.createDataFrame([(*d, "x", "y") for d in data], SCHEMA)
    return sorted(tuple(r) for r in addresses.same_place(df, "page_id", ["address", "contact_page_address"]).collect())


def test_pairs(spark):
    data = [(1, SAME[0], None), (2, "駐車場あり", SAME[3]), (3, SAME[1], "長里市東霧峰6-71-2"), (4, None, "長里市東霧峰6-71-2"), (5, None, None), (6, "", " "), (7, "x" * 100_000, None)]
    assert pairs(spark, data) == [(1, 2), (1, 3), (2, 3), (3, 4)]
    assert pairs(spark, []) == []


def test_missing_house_number_is_filled_by_the_building(spark):
    data = [(1, "長里市東霧峰6-71-1 パールビル 402号", None), (2, "長里市東霧峰6丁目71番地 パールBLDG 1F", None), (3, "長里市東霧峰6-71（ノース会館）", None), (4, "ノース会館2階 長里市東霧峰6-71", None)]
    assert pairs(spark, data) == [(1, 2), (3, 4)]


def test_areas_that_conflict(spark):
    data = [(1, "福羽市青田区東霧峰6-71-1", None), (2, "福羽市朝凪区東霧峰6-71-1", None), (3, "青田区東霧峰6-71-1", None)]
    assert pairs(spark, data) == [(1, 3)]


def test_doubtful_towns_without_a_sure_match(spark):
    data = [(1, "7-chome 54-2, Kaee, Asanagi-ku, Fukuha-shi", None), (2, "Kaee 7-54-2, Asanagi-ku", "Kaee 7-54-2, Asanagi-ku"), (3, "Kaee 7-54-3, Asanagi-ku", None), (4, "Kaee 7-54-2, Aota-ku", None)]
    assert pairs(spark, data) == [(1, 2)]
    assert pairs(spark, [*data, (5, "福羽市朝凪区亀江7-54-2", None)]) == [(1, 2), (1, 5), (2, 5)]


def test_area_chooses_among_known_readings(spark):
    data = [(1, "福羽市朝凪区亀江7-54-2", None), (2, "福羽市青田区金江7-54-2", None), (3, "Kaee 7-54-2, Aota-ku, Fukuha-shi", None), (4, "福羽市金江7-54-2", None)]
    assert pairs(spark, data) == [(2, 3), (2, 4), (3, 4)]


def test_unknown_latin_towns(spark):
    data = [(1, "Higashi-Qwertz 6-71-1, Nagasato-shi", None), (2, "6-chome 71-1 higashiqwertz, nagasato city, Japan", None), (3, "Higashi-Qwertz 6-71-2, Nagasato-shi", None), (4, "Nishi-Qwertz 6-71-1, Nagasato-shi", None)]
    assert pairs(spark, data) == [(1, 2)]
    assert addresses.parse("Tel 03-1234-5678") is None and addresses.parse("Updated 2024-05-01") is None


def test_towns_beyond_the_dictionaries(spark):
    """Real addresses, of which no name is in the dictionaries; other writings are learnt from the pages."""
    assert addresses.parse("福岡市中央区天神1-2-3")[0] == ("?天神",) and addresses.parse("福岡市中央区天神1-2-3")[4:] == ("中央", "福岡")
    assert addresses.parse("1-2-3 Tenjin, Chuo-ku, Fukuoka")[0] == ("?tenjin",)
    assert addresses.parse("1-9-1 Marunouchi, Chiyoda-ku, Tokyo")[0] == ("?marunouchi",)
    data = [
        (1, "福岡市中央区天神1-2-3", "1-2-3 Tenjin, Chuo-ku, Fukuoka"), (2, "1-2-3 Tenjin, Chuo-ku", None), (3, "1-2-4 Tenjin", None), (4, "〒810-0001 福岡市中央区天神1丁目2番4号", None),
        (5, "〒100-0005 東京都千代田区丸の内1-9-1", None), (6, "1-9-1 Marunouchi, Chiyoda-ku 100-0005", None), (7, "Marunouchi 1-9-1", None), (8, "大阪市中央区天神1-2-3", None),
    ]
    df = spark.createDataFrame(data, "page_id bigint, a string, b string")
    got = {tuple(r) for r in addresses.same_place(df, "page_id", ["a", "b"]).collect()}
    assert {(3, 4), (5, 6), (5, 7), (6, 7)} <= got and not {(1, 3), (1, 8), (1, 4)} & got
    classes = addresses.place_classes(df, "page_id", ["a", "b"]).collect()
    assert {(r.first_page_id, r.n_pages) for r in classes if r.page_id in (5, 6, 7)} == {(5, 3)}
