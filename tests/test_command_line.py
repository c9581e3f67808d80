"""The command line on a small CSV."""

from leadloom.__main__ import main
from leadloom.sources import files


def test_list_and_queries(spark, tmp_path, capsys):
    src = tmp_path / "in.csv"
    src.write_text("URL,店舗名,市区町村,リードスコア,営業優先度\nhttps://a.example/,花,福羽市,70,○\nhttp://www.a.example,花,福羽市,80,△\nhttps://b.example/,木,長里市,abc,\nhttps://bad.example/x,悪,長里市,99,○\n", encoding="utf-8-sig")
    (tmp_path / "blocked.txt").write_text("bad.example # portal\n")
    assert main(["list", str(src), str(tmp_path / "out"), "--blocked", str(tmp_path / "blocked.txt")]) == 0
    got = [tuple(r) for r in files.read_csv(spark, str(tmp_path / "out")).fillna("").collect()]
    assert got == [("花", "http://www.a.example", "福羽市", "80", "A", "△"), ("木", "https://b.example/", "長里市", "0", "C", "")]
    assert main(["queries"]) == 0 and "lead_list" in capsys.readouterr().out
