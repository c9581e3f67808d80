"""Tables that hold only empty texts, and batches without any result."""

from leadloom.llm import addresses, bpe, langid, mojibake


def test_only_empty_texts(spark):
    df = spark.createDataFrame([(1, "", "s", None), (2, None, "s", None), (3, " ", None, "en")], "doc_id bigint, text string, source string, lang string")
    assert {r.doc_id: r.ids for r in bpe.encode_table(df.where("doc_id < 3")).collect()} == {1: [], 2: []}
    assert langid.segments(df, langid.trained([])).count() == 0
    assert mojibake.garbled_fields(df.withColumnRenamed("doc_id", "name_id"), "name_id", ["text", "lang"]).count() == 0
    assert addresses.places(df.withColumnRenamed("doc_id", "page_id"), "page_id", ["text", "lang"]).count() == 0
