"""Problem 9: languages of documents and of their paragraphs by rank-order profiles.

The prose of a document in typesetting markup is taken apart into whole paragraphs
(abstracts, footnotes, list items and theorems included; comments, disabled text,
formulas, bibliography, author names and quoted sentences left out). A paragraph's
n-grams (1 to 3 letters within words) are ranked by frequency and compared with each
language's profile by the out-of-place distance: the sum over its n-grams of how far
the two ranks lie apart, at most the profile's length, which is also what an n-gram
costs that the profile doesn't hold.

The profiles start from a few built-in sentences and are fitted on a bounded sample of
labelled documents (``sample_docs``, the smallest hashes of the document id), twice:
first by label, then by the language just found, which outvotes wrong labels. N-grams
are counted by the executors; the driver receives the most frequent ones of each
language. All documents are classified, whole, and no step needs a shuffle of texts.

The seven languages of the corpus are fitted. Others have only their built-in sentences;
they keep a text from passing for one of the seven, and win only where they are nearer
by a margin. A text too little of which any profile knows is ``und``, in no language.

Defined results: null, empty and blank texts and texts without prose have no
segments; a paragraph with fewer than ``LEAST`` letters is none; ties go to the
language that stands first.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .bpe import chunks

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "ja")
#: Languages that are told apart beside those of the corpus.
OTHERS = ("nl", "pl", "sv", "ru", "ko", "zh")
UNKNOWN = "und"
LEAST = 12
#: Names of the languages in labels.
NAMES = {
    "en": "en eng english anglais englisch inglés ingles inglês inglese 英語", "de": "de deu ger german deutsch allemand alemán aleman alemão tedesco ドイツ語",
    "fr": "fr fra fre french français francais französisch francés frances francês francese フランス語", "es": "es spa spanish español espanol castellano espagnol spanisch espanhol spagnolo スペイン語",
    "pt": "pt por portuguese português portugues portugais portugiesisch portugués portoghese ポルトガル語", "it": "it ita italian italiano italien italienisch イタリア語",
    "ja": "ja jp jpn japanese japonais japanisch japonés japones japonês giapponese 日本語",
}
#: Built-in sentences from which the profiles start.
SEEDS = {
    "en": "In this section we show that the proposed method gives the same order as before, and that it does not depend on the size of the sample. However, there is no reason why this should hold for every path. What we have found is about the same, so the rest follows from it.",
    "de": "In diesem Abschnitt zeigen wir, dass die neue Methode die gleiche Ordnung ergibt und nicht von der Größe der Probe abhängt. Außerdem gibt es keinen Grund, warum das für jeden Weg gelten sollte. Der Wert beträgt etwa so viel wie zuvor; es folgt also nicht, dass er größer wird.",
    "fr": "Dans cette section, nous montrons que la méthode proposée donne le même ordre et qu'elle ne dépend pas de la taille de l'échantillon. Il n'y a aucune raison pour que cela soit vrai pour chaque chemin. La valeur est d'environ la même, donc le reste en découle comme prévu.",
    "es": "En esta sección mostramos que el método propuesto da el mismo orden y que no depende del tamaño de la muestra. Además, no hay ninguna razón para que esto se cumpla en todos los caminos. El valor es de unos pocos, así que el resto se deduce de lo anterior, como hallamos aquí.",
    "pt": "Nesta seção mostramos que o método proposto dá a mesma ordem e que não depende do tamanho da amostra. Além disso, não há nenhuma razão para que isso seja válido em todos os caminhos. O valor é de cerca do mesmo, portanto o resto segue do que foi encontrado até uma constante.",
    "it": "In questa sezione mostriamo che il metodo proposto dà lo stesso ordine e che non dipende dalla dimensione del campione. Inoltre non c'è alcuna ragione per cui questo debba valere per ogni cammino. Il valore è di circa lo stesso, quindi il resto segue da quello che abbiamo trovato.",
    "ja": "本節では、提案した手法が同じ順序を与えることを示す。また、これは標本の大きさに依存しない。しかし、すべての経路について成り立つわけではない。値はおよそ同じであり、残りの部分はここから得られる。定数を除いてより小さい誤差が見られた。",
    "nl": "In deze sectie laten we zien dat de voorgestelde methode dezelfde volgorde geeft en niet afhangt van de grootte van de steekproef. Bovendien is er geen reden waarom dit voor elk pad zou gelden. De waarde is ongeveer gelijk aan wat we eerder hebben gevonden, dus de rest volgt hieruit. Het is niet moeilijk om te zien dat een dergelijk resultaat ook voor grotere getallen geldt, hoewel het bewijs daarvan veel langer wordt. We geven eerst een kort overzicht van de begrippen die nodig zijn, en daarna een voorbeeld waarin het verschil tussen beide duidelijk wordt. Zoals wij in het vorige hoofdstuk hebben gezien, zijn er nog andere mogelijkheden die hier niet worden besproken.",
    "pl": "W tej części pokazujemy, że proponowana metoda daje ten sam porządek i nie zależy od wielkości próby. Ponadto nie ma powodu, dla którego miałoby to zachodzić dla każdej ścieżki. Wartość jest mniej więcej taka sama jak poprzednio, więc reszta wynika z tego, co znaleźliśmy.",
    "sv": "I detta avsnitt visar vi att den föreslagna metoden ger samma ordning och att den inte beror på urvalets storlek. Dessutom finns det ingen anledning till att detta skulle gälla för varje väg. Värdet är ungefär detsamma som tidigare, så resten följer av det som vi har funnit.",
    "ru": "В этом разделе мы показываем, что предложенный метод даёт тот же порядок и не зависит от размера выборки. Кроме того, нет никакой причины, по которой это должно выполняться для каждого пути. Значение примерно такое же, как и раньше, поэтому остальное следует из того, что мы нашли.",
    "ko": "이 절에서는 제안한 방법이 같은 순서를 주며 표본의 크기에 의존하지 않음을 보인다. 또한 이것이 모든 경로에 대해 성립할 이유는 없다. 값은 이전과 거의 같으므로 나머지는 우리가 찾은 것에서 따라 나온다. 그러나 이 결과는 더 작은 오차를 가진다.",
    "zh": "在本节中，我们证明所提出的方法给出相同的顺序，并且不依赖于样本的大小。此外，没有理由认为这对每条路径都成立。该值与之前大致相同，因此其余部分可以从我们所得到的结果中推出。但是这个结论在一般情况下是不成立的，我们将在下面说明这一点。",
}

MARKS = {"'": "́", "`": "̀", "^": "̂", '"': "̈", "~": "̃", "c": "̧", "=": "̄", ".": "̇", "u": "̆", "v": "̌", "H": "̋", "r": "̊", "k": "̨", "b": "", "d": "̣"}
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "i", "j": "j"}

COMMENT = re.compile(r"(?<!\\)((?:\\\\)*)%[^\n]*(?:\n[ \t]*)?")
DISABLED = re.compile(r"\\(?:iffalse|if0)\b.*?(?:\\fi\b|\Z)|\\begin\{comment\}.*?(?:\\end\{comment\}|\Z)", re.S)
SHOWN = r"equation|align|gather|multline|eqnarray|displaymath|math|flalign|figure|table|tabular|tikzpicture|verbatim|lstlisting|thebibliography|array|algorithm|algorithmic|picture"
BLOCK = re.compile(r"\\begin\{(" + SHOWN + r")\*?\}.*?(?:\\end\{\1\*?\}|\Z)|\\\[.*?(?:\\\]|\Z)|\$\$.*?(?:\$\$|\Z)", re.S)
INLINE = re.compile(r"(?<!\\)\$(?:[^$\\]|\\.)*\$|\\\(.*?\\\)", re.S)
QUOTED = re.compile(r"``.*?''|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」", re.S)
BREAK = re.compile(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\s*(?:\[[^\]]*\])?\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?|\\item\b(?:\[[^\]]*\])?|\\(?:maketitle|par|newpage|clearpage|appendix|tableofcontents)\b")
POINTER = re.compile(r"\\(?:[A-Za-z]*cite[A-Za-z]*|[A-Za-z]*ref|label|includegraphics|input|include|bibliographystyle|bibliography|usepackage|documentclass|newtheorem|date|vspace|hspace|url|href|DeclareMathOperator|renewcommand|newcommand|def)\*?\s*(?:\\[A-Za-z]+)?(?:\[[^\]]*\])*(?:\{(?:[^{}]|\{[^{}]*\})*\})*")
ACCENT = re.compile(r"\\([\'`^\"~=.])\s*(?:\{\\?([A-Za-z])\}|\\?([A-Za-z]))|\\([cuvHrkbd])(?:\s*\{\\?([A-Za-z])\}|\s+([A-Za-z]))")
LETTER = re.compile(r"\{?\\(ss|ae|AE|oe|OE|aa|AA|[oOlLij])(?![A-Za-z])\s*(?:\{\})?\}?")
COMMAND = re.compile(r"\\[A-Za-z]+\*?|\\.", re.S)
WORD = re.compile(r"[぀-ヿ一-鿿々가-힣]|[^\W\d_぀-ヿ一-鿿々가-힣]+")


def language_of_label(label: Column) -> Column:
    """The language that a label names, null if it names none of the seven."""
    first = F.regexp_extract(F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")), r"(?U)^([\p{L}\p{M}]+)(?:[-_ (@.].*)?$", 1)
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(first.isin(names.split(" ")), lang).otherwise(out)
    return out


def braced(text: str, at: int) -> int:
    """End of the group that opens at ``at``; the text's end if it never closes."""
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.S).finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if not depth:
            return m.end()
    return len(text)


def pull(text: str, command: re.Pattern) -> tuple[str, list[str]]:
    """Takes a command with its braced text out; the rest and the texts."""
    out, found, done = [], [], 0
    for m in command.finditer(text):
        if m.start() < done:
            continue
        end = braced(text, m.end() - 1)
        out.append(text[done : m.start()])
        found.append(text[m.end() : end].removesuffix("}"))
        done = end
    return "".join(out) + text[done:], found


TITLE, AUTHOR, FOOTNOTE = (re.compile(r"\\" + x + r"\s*(?:\[[^\]]*\])?\{") for x in ("title", "(?:author|address|email|affiliation|thanks|institute)", "footnote(?:text)?"))


def plain(text: str) -> str:
    """Words of a stretch of prose, accents as characters."""
    if "\\" in text or "$" in text:
        text = INLINE.sub(" ", text)
        text = LETTER.sub(lambda m: LETTERS[m[1]], text)
        text = ACCENT.sub(lambda m: (m[2] or m[3] or m[5] or m[6]) + MARKS[m[1] or m[4]], text)
        text = COMMAND.sub(" ", text)
    text = QUOTED.sub(" ", text).replace("{", "").replace("}", "")
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def prose(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The title and the paragraphs ``(kind, words)``; the first abstract has the kind ``abstract``."""
    text = text.replace("\r\n", "\n")
    if "%" in text:
        text = COMMENT.sub(r"\1", text)
    if "\\" in text:
        text = DISABLED.sub("", text)
    text, titles = pull(text, TITLE) if "\\title" in text else (text, [])
    if "\\" in text:
        text, _ = pull(text, AUTHOR)
        at = text.find("\\begin{document}")
        text = text[at + 16 :] if at >= 0 else text
        end = text.find("\\end{document}")
        text = text[:end] if end >= 0 else text
        text = BLOCK.sub("\n\n", text)
        text, notes = pull(text, FOOTNOTE)
        text = text.replace("\\begin{abstract}", "\n\n\x02").replace("\\end{abstract}", "\n\n")
        text = POINTER.sub(" ", BREAK.sub("\n\n", text))
        notes = [POINTER.sub(" ", n) for n in notes]
    else:
        notes = []
    out = []
    for part in re.split(r"\n[ \t]*(?:\n\s*)+", text):
        kind = "abstract" if "\x02" in part else "body"
        if sum(map(str.isalpha, words := plain(part.replace("\x02", "")))) >= LEAST:
            out.append((kind, words))
    for n in notes:
        if sum(map(str.isalpha, words := plain(n))) >= LEAST:
            out.append(("footnote", words))
    return (plain(POINTER.sub(" ", titles[0])) if titles else ""), out


def grams(word: str) -> Iterator[str]:
    w = f"_{word}_"
    for n in (1, 2, 3):
        for i in range(len(w) - n + 1):
            if w[i : i + n] != "_":
                yield w[i : i + n]


class Profiles:
    """Rank-order profiles of the languages and the classification by them."""

    def __init__(self, counts: dict[str, Counter], size: int = 400, least_known: float = 0.2, margin: float = 0.03):
        tops = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]] for lang, c in counts.items()}
        self.size, self.least_known, self.margin = size, least_known, margin
        self.names = [x for x in (*LANGUAGES, *OTHERS) if x in tops]
        self.fitted = sum(x in LANGUAGES for x in self.names)
        self.ids = {g: i for i, g in enumerate(sorted(set().union(*tops.values())))}
        self.rank = np.full((len(self.names), len(self.ids) + 1), size, dtype=np.int32)  # the last one stands for n-grams of no profile
        for k, lang in enumerate(self.names):
            for r, g in enumerate(tops[lang]):
                self.rank[k, self.ids[g]] = r
        self.held = self.rank < size
        self.memo: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        """Numbers of a word's n-grams; those of no profile have numbers beyond, by their digest."""
        held = self.memo.get(w)
        if held is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            get, over = self.ids.get, len(self.ids)
            held = self.memo[w] = np.array([i if (i := get(g)) is not None else over + zlib.crc32(g.encode()) for g in grams(w)], dtype=np.int64)
        return held

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text (columns) the mean distance to each profile (rows), the share of its n-grams in no profile of the corpus, and whether it has any."""
        found = [[self.word(w) for w in WORD.findall(t.lower())] for t in texts]
        sizes = [sum(map(len, f)) for f in found]
        flat = np.concatenate([a for f in found for a in f] or [np.zeros(0, np.int64)])
        cell, counts = np.unique((np.repeat(np.arange(len(texts), dtype=np.int64), sizes) << 33) | flat, return_counts=True)
        row, gram = cell >> 33, cell & ((1 << 33) - 1)
        # by text, then falling count, then n-gram
        order = np.lexsort((gram, -counts, row))
        row, gram = row[order], gram[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(texts)))[row]
        use = place < self.size
        row, gram, place = row[use], np.minimum(gram[use], len(self.ids)), place[use]
        n = np.maximum(np.bincount(row, minlength=len(texts)), 1)
        away = np.stack([np.bincount(row, np.where(h[gram], np.minimum(np.abs(r[gram] - place), self.size), self.size), minlength=len(texts)) for r, h in zip(self.rank, self.held)]) / (n * self.size)
        foreign = np.bincount(row, ~self.held[: self.fitted].any(axis=0)[gram], minlength=len(texts)) / n
        return away, foreign, np.bincount(row, minlength=len(texts)) > 0

    def classify(self, texts: list[str], block: int = 400) -> list[tuple[str, float, str]]:
        """Language, confidence and the next language of each text.

        The confidence is how much nearer the nearest profile is than the next one, beside what n-grams
        of no profile cost alike for all. ``und`` has the confidence 0.
        """
        out: list[tuple[str, float, str]] = []
        for at in range(0, len(texts), block):
            part = texts[at : at + block]
            away, foreign, some = self.distances(part)
            main, other = away[: self.fitted], away[self.fitted :]
            ranked = np.argsort(main, axis=0, kind="stable")
            best, second = np.take_along_axis(main, ranked[:1], 0)[0], np.take_along_axis(main, ranked[1:2], 0)[0]
            sure = np.where(second > foreign, (second - best) / np.maximum(second - foreign, 1e-9), 0.0)
            beyond = other.min(axis=0) if len(other) else np.ones(len(part))
            for i in range(len(part)):
                a, b = self.names[ranked[0, i]], self.names[ranked[1, i]]
                if beyond[i] < best[i] - self.margin:
                    out.append((self.names[self.fitted + int(other[:, i].argmin())], round(float((best[i] - beyond[i]) / best[i]), 4), a))
                elif not some[i] or 1 - best[i] < self.least_known * (1 - np.exp(-len(part[i]) / 100)):
                    out.append((UNKNOWN, 0.0, a))
                else:
                    out.append((a, round(float(sure[i]), 4), b))
        return out


def count_grams(texts: list[str]) -> Counter:
    words = Counter(w for t in texts for w in WORD.findall(t.lower()))
    out: Counter = Counter()
    for w, n in words.items():
        for g in grams(w):
            out[g] += n
    return out


def seeds() -> dict[str, Counter]:
    return {lang: count_grams([t]) for lang, t in SEEDS.items()}


def accepted(made: Profiles, label: str, parts: list[str], unsure: float = 0.15) -> list[str]:
    """The paragraphs of a labelled document from which its language's profile is fitted: none if the label isn't the language of most of its text, else those that are not surely in another language."""
    own = made.classify(parts)
    sizes: Counter = Counter()
    for (lang, *_), t in zip(own, parts):
        sizes[lang] += len(t)
    if not sizes or max(sizes, key=sizes.get) != label:
        return []
    return [t for (lang, sure, _), t in zip(own, parts) if lang == label or sure < unsure]


def fit(documents: DataFrame, sample_docs: int = 1500, rounds: int = 2, size: int = 400) -> Profiles:
    """Profiles from the built-in sentences and at most ``sample_docs`` labelled documents, whose n-grams the executors count."""
    labelled = documents.select("doc_id", language_of_label(F.col("lang")).alias("label")).where("label is not null and doc_id is not null")
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = cut(documents.where("text is not null").join(chosen, "doc_id").select("label", "text").repartition(32))
    made = Profiles(seeds(), size)
    for _ in range(rounds):
        held = documents.sparkSession.sparkContext.broadcast(made)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in chunks(batches, "text"):
                counts: dict[str, Counter] = {}
                for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist()):
                    counts.setdefault(label, Counter()).update(count_grams(accepted(held.value, label, [words for _, words in prose(text)[1]])))
                rows = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])

        start = documents.sparkSession.createDataFrame([(lang, g, n) for lang, c in seeds().items() if lang in LANGUAGES for g, n in c.items()], "lang string, gram string, n bigint")
        total = sample.mapInArrow(run, "lang string, gram string, n bigint").unionAll(start).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
        tops = total.withColumn("place", F.row_number().over(best)).where(F.col("place") <= size).collect()  # languages x size
        counts = {lang: c for lang, c in seeds().items() if lang in OTHERS}
        for r in tops:
            counts.setdefault(r.lang, Counter())[r.gram] = r.n
        made = Profiles(counts, size)
    return made


def trained(documents: list[tuple[str, list[str]]], rounds: int = 2) -> Profiles:
    """Profiles of documents given as (label, paragraphs), like ``fit`` in one process."""
    made = Profiles(seeds())
    for _ in range(rounds):
        counts = seeds()
        for label, parts in documents:
            if label in LANGUAGES:
                counts[label].update(count_grams(accepted(made, label, parts)))
        made = Profiles(counts)
    return made


def settled(got: list[tuple[str, float, str]], sizes: list[int], near: float = 0.05) -> list[tuple[str, float]]:
    """Languages of one document's main text (first) and paragraphs, close calls decided by the document.

    Where the main text's two nearest languages are nearly equal, the one in which more of the
    document is written holds; a paragraph that is nearly as close to the main language is in it.
    """
    (main, sure, second), rest = got[0], got[1:]
    if sure < near:
        size = Counter()
        for (lang, *_), n in zip(rest, sizes[1:]):
            size[lang] += n
        main = second if size[second] > size[main] else main
    return [(main, sure)] + [(main if s < near and b == main else a, s) for a, s, b in rest]


SEGMENTS = "doc_id bigint, segment int, kind string, lang string, confidence double, n_chars int"


def segments(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """One row per document's paragraph, and one with the kind ``main`` (segment 0) for its title and first abstract."""
    held = documents.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            keys, texts = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if not text or not (parts := prose(text))[1]:
                    continue
                title, parts = parts
                first = next((w for k, w in parts if k == "abstract"), None)
                keys.append((doc, 0, "main"))
                texts.append(f"{title} {first or ''}" if first or sum(map(str.isalpha, title)) >= LEAST else parts[0][1])
                for i, (kind, words) in enumerate(parts):
                    keys.append((doc, i + 1, kind))
                    texts.append(words)
            sizes = [len(t) for t in texts]
            raw, got = held.value.classify(texts), []
            starts = [i for i, k in enumerate(keys) if not k[1]] + [len(keys)]
            for i, j in zip(starts, starts[1:]):
                got += settled(raw[i:j], sizes[i:j])
            cols = [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], [a for a, _ in got], [s for _, s in got], sizes]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32()))], names=[x.split(" ")[0] for x in SEGMENTS.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, SEGMENTS)


def found(documents: DataFrame, profiles: Profiles, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``doc_id, lang`` of documents whose label is missing or wrong or that hold paragraphs of several languages; paragraphs in none of ``languages`` don't count."""
    label = documents.select("doc_id", language_of_label(F.col("lang")).alias("label"))
    held = segments(documents, profiles).groupBy("doc_id").agg(
        F.max(F.when(F.col("kind") == "main", F.col("lang"))).alias("main"), F.collect_set(F.when((F.col("kind") != "main") & F.col("lang").isin(*languages), F.col("lang"))).alias("langs")
    )
    cases = held.join(label, "doc_id").where("label is null or label <> main or size(langs) > 1")
    return cases.select("doc_id", F.explode("langs").alias("lang"))
