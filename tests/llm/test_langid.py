"""Language of documents and paragraphs: markup, mixtures, labels, edge cases."""

import pytest
from pyspark.sql import functions as F

from leadloom.llm import langid

EN = "We show that the method yields the same order for every sample, and that it does not depend on the size of what was measured before."
DE = "Wir zeigen, dass das Verfahren für jede Probe die gleiche Ordnung ergibt und dass es nicht von der Größe der Messung abhängt."
JA = "本節では、この方法がすべての標本について同じ順序を与えることを示す。また、これは大きさに依存しない。"


@pytest.fixture(scope="module")
def profiles():
    return langid.trained([])


def test_profiles_from_built_in_sentences(profiles):
    texts = {"en": EN, "de": DE, "ja": JA, "fr": "Nous montrons que la méthode donne le même ordre pour chaque échantillon et qu'elle ne dépend pas de la taille.", "es": "Mostramos que el método da el mismo orden para cada muestra y que no depende del tamaño de la medición.",
             "pt": "Mostramos que o método dá a mesma ordem para cada amostra e que não depende do tamanho da medição feita.", "it": "Mostriamo che il metodo dà lo stesso ordine per ogni campione e che non dipende dalla dimensione della misura."}
    got = profiles.classify(list(texts.values()))
    assert [g[0] for g in got] == list(texts) and all(0 <= g[1] <= 1 for g in got)


def test_prose():
    doc = (
        "\\documentclass{article}\n\\title{On things}\n\\author{D\\'eb\\^ora M\\\"uller}\n\\begin{document}\n\\maketitle\n% " + DE + "\n\\begin{abstract}\n" + EN + "\n\\end{abstract}\n"
        + EN + "\\footnote{" + DE + "} ``" + JA + "'' more words here.\n\n\\[ x = 1 \\]\n\\iffalse\n" + DE + "\n\\fi\n\\begin{itemize}\n\\item " + JA + "\n\\end{itemize}\nR\\'esum\\'e {\\ss} \\c{c}a na\\\"{\\i}ve.\n\\begin{thebibliography}{9}\\bibitem{a} " + DE
    )
    title, parts = langid.prose(doc)
    assert title == "On things" and [k for k, _ in parts] == ["abstract", "body", "body", "body", "footnote"]
    assert JA not in parts[1][1] and "more words" in parts[1][1] and parts[2][1].strip() == JA and "Résumé" in parts[3][1] and "ça naïve" in parts[3][1] and parts[4][1] == DE
    assert langid.prose("") == ("", []) and langid.prose("\\begin{document}$x$\\end{document}")[1] == []


def test_labels(spark):
    cases = {"EN": "en", "en-GB": "en", " German ": "de", "fr_FR": "fr", "jpn": "ja", "Português": "pt", "": None, "und": None, "-": None, "xx": None, "nl": None, None: None, "ita": "it"}
    df = spark.createDataFrame([(k,) for k in cases], "lang string")
    assert {r.lang: r.got for r in df.select("lang", langid.language_of_label(F.col("lang")).alias("got")).collect()} == cases


def test_found(spark, profiles):
    docs = [(1, EN, "en"), (2, EN, "de"), (3, EN, None), (4, EN + "\n\n" + DE, "en"), (5, None, "en"), (6, "", None), (7, "  \n ", "x"), (8, "\\begin{document}\n\\[x\\]\n", None), (9, JA, "ja-JP"), (10, (EN + "\n\n") * 2000, "English")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id bigint, text string, lang string, kind string")
    assert sorted(tuple(r) for r in langid.found(df, profiles).collect()) == [(2, "en"), (3, "en"), (4, "de"), (4, "en")]
    assert langid.segments(df, profiles).where("doc_id = 10").count() == 2001
    assert langid.found(df.limit(0), profiles).count() == 0
    assert langid.fit(df.limit(0)).classify([DE])[0][0] == "de"


OTHER = {
    "ru": "Мы рассматриваем задачу о распределении простых чисел в коротких интервалах и доказываем новую оценку.", "ko": "우리는 짧은 구간에서 소수의 분포에 관한 문제를 고려하고 새로운 추정을 증명한다.",
    "zh": "我们研究短区间内素数分布的问题，并证明了一个新的估计。这一结果改进了以前的工作。", "nl": "Wij beschouwen het probleem van de verdeling van priemgetallen in korte intervallen en bewijzen een nieuwe schatting die beter is dan het vorige resultaat.",
    "pl": "Rozważamy problem rozmieszczenia liczb pierwszych w krótkich przedziałach i dowodzimy nowego oszacowania.", "und": "Εξετάζουμε το πρόβλημα της κατανομής των πρώτων αριθμών σε σύντομα διαστήματα.",
}


def test_other_languages_are_not_taken_for_one_of_the_corpus():
    made = langid.trained([])
    for lang, text in OTHER.items():
        assert made.classify([text])[0][0] == lang
    assert made.classify([""]) == [("und", 0.0, "en")]


def test_an_ngram_of_no_profile_costs_the_whole_penalty():
    made = langid.trained([])
    away, foreign, some = made.distances(["щщщ"])
    assert away[: made.fitted].min() == 1.0 and foreign[0] == 1.0 and some[0]


def test_fit_counts_in_the_executors_like_one_process(spark):
    docs = [(i, f"\\begin{{document}}\\begin{{abstract}}{langid.SEEDS[lang]}\\end{{abstract}}\\end{{document}}", lang) for i, lang in enumerate(langid.LANGUAGES)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    one = langid.trained([(lang, [w for _, w in langid.prose(t)[1]]) for _, t, lang in docs])
    many = langid.fit(df)
    assert one.ids == many.ids and (one.rank == many.rank).all()
