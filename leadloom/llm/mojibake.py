"""Problem 4: text that was decoded with the wrong character encoding.

For every pair of a true and a wrong encoding the garbled sequences of the characters
that names are made of are computed in advance and put into one multi-pattern
automaton (built once per worker; its size follows from the repertoire, not from the
data). A text is scanned once. Where sequences of a pair match, the bytes behind the
matched span are decoded anew, and only that span is replaced, so that correct text
beside it stays. Doubly garbled text is unwound step by step. ISO-2022-JP read as ASCII
has no such sequences: its chains are found by their shifts, with or without the escape
byte, and closed or cut off at the end.

Sequences that sound text may hold by chance need support: two neighbours, kana among
the restored characters, or Latin letters around a lone letter. Where the same span
makes sense in several true encodings (Japanese, Chinese, Korean, Cyrillic), the one
whose characters are all in common use is taken; on a tie nothing is restored.

Beside the automaton four patterns flag what no sequence of whole characters shows:
replacement and private characters and C1 controls (which no sound text holds and which
can't be restored), half-width kana pairs, and first bytes of ideographs between other
signs (they support a run of sequences that was found), and a lone letter of another
script in a Latin word. A lone letter that looks like a Latin one is no evidence where
its letter case or an intact accented letter beside it speaks against it.

Defined results: null, empty and sound texts give no case; ``restored`` is null where
some of the text is beyond repair. Layers are undone until none is left.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LOST = "�"
#: Fixed values: (true encoding, wrong encoding). sloppy_1252 is cp1252 with its undefined bytes as C1 controls.
PAIRS = [
    ("utf-8", "sloppy_1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("utf-8", "cp932"), ("utf-8", "gbk"), ("utf-8", "euc_jp"),
    ("cp932", "sloppy_1252"), ("cp932", "latin-1"), ("cp932", "mac_roman"), ("cp932", "cp1251"), ("cp932", "gbk"),
    ("euc_jp", "sloppy_1252"), ("euc_jp", "latin-1"), ("euc_jp", "mac_roman"), ("euc_jp", "cp1251"), ("euc_jp", "cp932"), ("euc_jp", "gbk"),
    ("latin-1", "cp1251"), ("latin-1", "mac_roman"), ("latin-1", "cp932"), ("latin-1", "gbk"),
    ("utf-8", "cp850"), ("utf-8", "cp437"), ("cp1251", "sloppy_1252"), ("cp1251", "latin-1"), ("gbk", "sloppy_1252"), ("gbk", "latin-1"), ("euc_kr", "sloppy_1252"), ("euc_kr", "latin-1"),
]
CHAIN = {
    "utf-8": rb"(?:[\xC2-\xDF][\x80-\xBF]|[\xE1-\xEF][\x80-\xBF]{2}|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\x20-\x7E])+",
    "cp932": rb"(?:[\x81-\x9F\xE0-\xFC][\x40-\x7E\x80-\xFC]|[\xA1-\xDF]|[\x20-\x7E])+",
    "euc_jp": rb"(?:\x8F[\xA1-\xFE]{2}|[\xA1-\xFE]{2}|\x8E[\xA1-\xDF]|[\x20-\x7E])+",
    "latin-1": rb"[\x20-\x7E\xA0-\xFF]+",
    "cp1251": rb"[\x20-\x7E\xA8\xB8\xC0-\xFF]+",
    "gbk": rb"(?:[\xA1-\xFE]{2}|[\x20-\x7E])+",
    "euc_kr": rb"(?:[\xA1-\xFE]{2}|[\x20-\x7E])+",
}
SINGLE = ("sloppy_1252", "latin-1", "mac_roman", "cp850", "cp437")
#: Other true encodings of the bytes behind Japanese text that was read with a single-byte encoding.
RIVALS = ("gbk", "euc_kr", "cp1251")
WIDE = ("cp932", "gbk", "euc_jp")
PUNCTUATION = "、。・「」『』【】〔〕（）！？：；｜～〜…‥ー―〒※★☆♪○△×　＆＋－／"
#: Accented Latin letters, the one kind of letter whose garbled form is short.
SMALL = frozenset(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))))
SIGNS = "–—‘’“”„•…€™¡¿«»°·"


SOUND = re.compile(r"[ -~À-ÖØ-öø-ÿ–-”…•€ぁ-ヿ一-龯　-〕！-｝×°·¡¿«»]+")
#: First characters of kana and signs read with a wide encoding; in a restored text they are left from lost bytes.
REST = re.compile("[縺繧繝窶銈銉銇鈥]")


#: cp1252 both ways, its undefined bytes as C1 controls; C1 characters of defined bytes can't be encoded.
SLOPPY = {b: chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in range(0x80, 0xA0)}
UNSLOPPY = {b: "\uffff" for b in SLOPPY} | {ord(c): chr(b) for b, c in SLOPPY.items()}


def to_bytes(text: str, encoding: str) -> bytes | None:
    try:
        return text.translate(UNSLOPPY).encode("latin-1") if encoding == "sloppy_1252" else text.encode(encoding)
    except UnicodeEncodeError:
        return None


def to_text(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode("latin-1").translate(SLOPPY) if encoding == "sloppy_1252" else data.decode(encoding)
    except UnicodeDecodeError:
        return None


char_bytes = functools.lru_cache(maxsize=50_000)(to_bytes)


def is_kana(ch: str) -> bool:
    return "ぁ" <= ch <= "ゖ" or "ァ" <= ch <= "ー"


def is_han(ch: str) -> bool:
    return "一" <= ch <= "鿿"


def repertoire() -> tuple[str, str]:
    """Characters of Japanese names (kana, signs, the two kanji levels of the national standard) and accented Latin letters."""
    kana = [chr(n) for n in (*range(0x3041, 0x3097), *range(0x30A1, 0x30FD))]
    kanji = []
    for lead in (*range(0x88, 0xA0), *range(0xE0, 0xEB)):
        for trail in (*range(0x40, 0x7F), *range(0x80, 0xFD)):
            ch = to_text(bytes([lead, trail]), "cp932")
            if ch and is_han(ch):
                kanji.append(ch)
    wide = [chr(n) for n in range(0xFF10, 0xFF5B)]
    latin = [chr(n) for n in (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))]
    return "".join(kana) + PUNCTUATION + "".join(kanji) + "".join(wide), "".join(latin) + SIGNS


def other_scripts() -> str:
    """Letters of Greek and Cyrillic, Hangul syllables of the Korean standard and ideographs of the first level of the Chinese one."""
    letters = [chr(n) for n in (*range(0x391, 0x3CA), *range(0x410, 0x450), 0x401, 0x451) if n != 0x3A2]
    pairs = lambda low, high, encoding: [c for a in range(low, high) for b in range(0xA1, 0xFF) if (c := to_text(bytes([a, b]), encoding))]
    return "".join([*letters, *pairs(0xB0, 0xC9, "euc_kr"), *pairs(0xB0, 0xD8, "gb2312")])


def rare(text: str, true: str) -> int:
    """Number of a text's characters beyond ASCII that are not in common use where ``true`` is written."""
    n = 0
    for c in text:
        if c.isascii():
            continue
        if true == "cp1251":
            n += not ("А" <= c <= "я" or c in "Ёё")
        elif true == "euc_kr":
            n += not "가" <= c <= "힣"
        elif true == "gbk":
            b = char_bytes(c, "gb2312")
            n += not (b and (0xB0 <= b[0] <= 0xD7 or b[0] < 0xA4))
        else:
            b = char_bytes(c, "euc_jp")
            n += not (b and len(b) == 2 and 0xA1 <= b[0] <= 0xCF or is_kana(c))
    return n


@functools.lru_cache(maxsize=1)
def automaton():
    """The automaton: garbled sequence -> tuple of (pair number, weight); weight 2 proves, 1 needs support."""
    import ahocorasick

    east, latin = repertoire()
    held: dict[str, dict[int, int]] = {}
    common = set(east)
    others = [c for c in other_scripts() if c not in common]
    slavic = [chr(n) for n in (*range(0x410, 0x450), 0x401, 0x451)]
    for at, (true, wrong) in enumerate(PAIRS):
        if true == "utf-8" and wrong in SINGLE:
            for ch in others:
                if s := to_text(ch.encode(), wrong):
                    held.setdefault(s, {})[at] = 2
        elif true == "cp1251":  # letters alone are accented letters of sound words
            for a in slavic:
                for b in slavic:
                    if (s := to_text((a + b).encode(true), wrong)) and not s.isascii():
                        held.setdefault(s, {})[at] = 1
    follow = [b"\xe3", *[bytes([n]) for n in range(0xE4, 0xEA)], b"\xef", b"\xe2", b"\xc3", b" ", b"-"]
    letters = [bytes([n]) for n in (*range(0x41, 0x5B), *range(0x61, 0x7B))]
    for at, (true, wrong) in enumerate(PAIRS):
        for ch in east + latin:
            small = ch in latin
            data = to_bytes(ch, true)
            if true in RIVALS or data is None or len(data) < 2 or (true != "utf-8" and small and true != "euc_jp"):
                continue
            seqs = {to_text(data, wrong)}
            if wrong in WIDE:
                # the last byte may form a character with the next one
                after = [*letters, b" "] if small else follow if true == "utf-8" else [b"\xa4", b"\xa5", b"\x82", b"\x83"] + [bytes([n]) for n in range(0xB0, 0xD0)]
                if ch in PUNCTUATION:
                    after = [*after, *letters]
                if small or len(data) % 2 or None in seqs:
                    seqs |= {to_text(data + f, wrong) for f in after}
                if data[:1] == b"\xef" and wrong == "cp932":  # its first byte is lost
                    seqs |= {to_text(data[1:] + f, wrong) for f in after}
                seqs = {s if s is None or s[-1] not in " -" and not s[-1].isascii() else s[:-1] for s in seqs}
            for s in seqs:
                if s and len(s) >= 2 and not s.isascii():
                    single = wrong in SINGLE
                    strong = (true == "utf-8" and not (small and wrong in WIDE) or small and true == "euc_jp") and (single or len(data) == 3 and not small)
                    held.setdefault(s, {})[at] = 2 if strong else 1
    made = ahocorasick.Automaton()
    for s, pairs in held.items():
        made.add_word(s, (len(s), tuple(pairs.items())))
    made.make_automaton()
    return made


@functools.lru_cache(maxsize=1)
def swallowed() -> frozenset[str]:
    """What an accented letter, alone or with the letter after it, becomes in a wide encoding."""
    latin = [c for c in repertoire()[1] if c.isalpha()]
    letters = [bytes([n]) for n in (*range(0x41, 0x5B), *range(0x61, 0x7B))]
    made = {to_text(to_bytes(c, "utf-8"), "gbk") for c in latin}
    made |= {to_text(to_bytes(c, "latin-1") + f, w) for c in latin for f in letters for w in WIDE}
    made |= {to_text(data + f, "cp932") for c in latin if (data := to_bytes(c, "euc_jp")) and len(data) == 3 for f in (b"", *letters)}
    made |= {to_text(to_bytes(c, "utf-8") + f, "cp932") for c in latin for f in (b"", *letters)}
    made = {x if not x[-1].isascii() else x[:-1] for x in made if x}
    return frozenset(x for x in made if x and not x.isascii() and (len(x) > 1 or is_han(x)))


#: Half-width kana without voicing marks whose bytes are common ideographs of the other Japanese encoding.
HALF = re.compile("(?:[ｰ-ﾏ][｡-ﾝ]){3,}")
#: Three first bytes of ideographs between other characters, as single-byte text.
LEADS = re.compile("(?:[ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ][!-ÿ€-™]){2}|[à-ê][!-ÿ€-™](?:[ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ][!-ÿ€-™]){2}")
#: Ideographs as pairs of high Latin-1 characters: six of them, or four with signs among them.
HIGH = re.compile("(?:[°-Ï][¡-þ]){3,}|(?=.*[¡-¿].*[¡-¿])(?:[°-Ï][¡-þ]){2}")
#: Separators of the other Japanese encoding at Latin words, and private characters, which no decoder gives for sound text.
BROKEN = re.compile("(?<=[A-Za-z])(?:｡[｢ｨﾃｦ]|¡[¢¨Ã¦])|(?:｡[｢ｨﾃｦ]|¡[¢¨Ã¦])(?=[A-Za-z])|[\ue000-\uf8ff\x80-\x84\x86-\x9f]")

#: A lone letter of another script at a Latin word: Cyrillic, or what may be a swallowed letter.
LONE = re.compile("(?<=[A-Za-z])(?:[Ѐ-ӿ](?![Ѐ-ӿ])|(?P<a>[⺀-鿿ｦ-ﾟ]{1,4})(?![⺀-鿿ｦ-ﾟ]))|(?<![Ѐ-ӿA-Za-z⺀-鿿ｦ-ﾟ])(?:[Ѐ-ӿ]|(?P<b>[⺀-鿿ｦ-ﾟ]{1,4}))(?=[a-z]{2})")


#: Cyrillic letters that look like Latin ones.
ALIKE = frozenset("АВЕЅІЈКМНОРСТУХаеіјорсухѕ")
#: Words of other scripts, which a restored text may hold.
FOREIGN = re.compile("[Ѐ-ӿ]{2,}|[Ͱ-Ͽ]{2,}|[가-힣]+")


#: ISO-2022-JP read as ASCII: a shift, pairs of bytes, and the shift back, or what is left of it where the text is cut off.
SHIFTED = re.compile(r"(?P<esc>\x1b?)\$[B@](?P<body>(?:[!-~]{2})+?)(?:(?P<back>\x1b?\([BJ])|(?P<cut>[!-~]|\x1b\(?)?(?![!-~]))")
SHIFTS = "iso2022_jp/ascii"


@functools.lru_cache(maxsize=10_000)
def jis_char(pair: str) -> str | None:
    """The character of two bytes of ISO-2022-JP, also of the rows that vendors added (㈱, ①)."""
    a, b = pair.encode("ascii")
    lead = (a - 0x21 >> 1) + (0x81 if a < 0x5F else 0xC1)
    trail = b + (0x1F if b < 0x60 else 0x20) if a % 2 else b + 0x7E
    return to_text(b"\x1b$B" + bytes([a, b]) + b"\x1b(B", "iso2022_jp") or to_text(bytes([lead, trail]), "cp932")


def unshift(text: str) -> tuple[str, bool, str, bool]:
    """``text`` with its ISO-2022-JP chains decoded, whether it has any, the characters restored, and whether all could be."""
    if "$" not in text and "\x1b" not in text:
        return text, False, "", True
    out, made, done, at, found, whole = [], [], 0, 0, False, True
    while m := SHIFTED.search(text, at):
        body = m["body"]
        chars = [jis_char(body[i : i + 2]) for i in range(0, len(body), 2)]
        kana = sum(is_kana(c) for c in chars if c)
        # sound text may hold an open chain without escape byte by chance
        signs = sum(not c.isalnum() for c in body)
        sure = m["esc"] or (m["back"] or len(chars) > 1) and kana or None not in chars and (m["back"] or len(chars) > 2 and signs > 1 and all(map(is_han, chars)))
        if not sure:
            at = m.start() + 2
            continue
        found, at = True, m.end()
        if None in chars or m["cut"] not in (None, "(", "\x1b", "\x1b("):
            whole = False
            continue
        out += [text[done : m.start()], *chars]
        made += chars
        done = at
    new = "".join(out) + text[done:]
    bare = re.sub(r"\x1b\([BJ]", "", new)
    return bare, found or bare != new, "".join(made), whole


def lone_letters(text: str) -> list[tuple[int, int]]:
    """Spans of lone letters at Latin words."""

    def letters_only(east: str) -> bool:
        return any((new := to_text(to_bytes(east, w) or b"\xff", t)) and set(new) <= SMALL for t, w in (("euc_jp", "cp932"), ("utf-8", "cp932"), ("utf-8", "gbk")))

    def alike(m: re.Match) -> bool:
        """Whether a Cyrillic letter may be meant for the Latin one that it looks like."""
        a, b = m.span()
        near = text[a - 1 : a] + text[b : b + 1]
        return m[0] in ALIKE and (m[0].isupper() and bool(re.search("[a-z]", text[max(0, a - 1) : a])) or m[0].islower() and near.isupper() or any(c in SMALL for c in text))

    return [m.span() for m in LONE.finditer(text) if ((east := m["a"] or m["b"]) is None and not alike(m)) or east is not None and (east in swallowed() or len(east) > 2 and letters_only(east))]


def respell(text: str, at: int, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """``text`` with the chains of pair ``at`` that touch ``spans`` decoded anew, and the number of characters replaced."""
    true, wrong = PAIRS[at]
    out, done, i, n = [], 0, 0, len(text)
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    ends = [b for _, b in merged]

    def touched(lo: int, hi: int) -> bool:
        k = bisect_left(ends, lo + 1)
        return k < len(merged) and merged[k][0] < hi

    while i < n:
        data, offsets, j = bytearray(), [0], i
        while j < n and (b := char_bytes(text[j], wrong)) is not None:
            data += b
            offsets.append(len(data))
            j += 1
        if j == i:
            out.append(text[i])
            i += 1
            continue
        place = {o: k for k, o in enumerate(offsets)}
        last = 0
        for m in re.finditer(CHAIN[true], bytes(data)):
            a, z = m.span()
            while a not in place and a < z:
                a += 1
            while z not in place and z > a:
                z -= 1
            new = to_text(bytes(data[a:z]), true) if a < z else None
            if new is None or place[a] < last:
                continue
            lo, hi = i + place[a], i + place[z]
            if new != text[lo:hi] and touched(lo, hi):
                out += [text[i + last : lo], new]
                done += hi - lo
                last = place[z]
        out.append(text[i + last : j])
        i = j
    return "".join(out), done


def supported(text: str, at: int, a: int, b: int) -> bool:
    """Whether a run of sequences that sound text may hold by chance, from ``a`` to ``b``, is garbled after all."""
    true, wrong = PAIRS[at]
    run = text[a:b]
    if true == "cp1251":
        return b - a >= 5 and not re.search("[A-Za-z]", text[max(0, a - 1) : a] + text[b : b + 1])
    if true == "utf-8" or true == "euc_jp" and to_text(to_bytes(run, wrong) or b"", true) in SMALL:
        near = text[max(0, a - 1) : a] + text[b : b + 1]
        return bool(re.search("[A-Za-z]", near)) and not re.search("[ｦ-ﾟ]", near)
    if b - a < 4:
        return False
    if wrong == "cp932" and true == "euc_jp" and HALF.fullmatch(run):
        return True
    lo, near = max(0, a - 16), text[max(0, a - 16) : b + 16]  # the run with its surroundings, whatever the length of the text
    kana = sum(map(is_kana, respell(near, at, [(a - lo, b - lo)])[0])) - sum(map(is_kana, near))
    if kana >= 2 or kana == 1 and b - a == len(text):
        return True
    if wrong in WIDE or wrong == "cp1251" or re.search("[A-Za-z ]{2}", run):
        return False
    if kana == 1 and (true == "euc_jp" or b - a >= 6) or b - a >= 8:
        return True
    return bool(re.search("[\x80-\x9f]", run) or LEADS.search(run) or true == "euc_jp" and HIGH.fullmatch(run))


def spans_of(text: str) -> dict[int, list[tuple[int, int]]]:
    """For each pair with sufficient evidence the spans where its sequences match."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for end, (size, pairs) in automaton().iter(text):
        for at, weight in pairs:
            found.setdefault(at, []).append((end + 1 - size, end + 1, weight))
    out: dict[int, list[tuple[int, int]]] = {}
    for at, hits in found.items():
        true, wrong = PAIRS[at]
        spans = [(a, b) for a, b, w in hits if w == 2]
        if not spans:
            runs: list[list[int]] = []
            for a, b, _ in sorted(hits):
                if runs and a <= runs[-1][1] + 1:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            spans = [(a, b) for a, b in runs if supported(text, at, a, b)]
        if spans:
            out[at] = spans
    return out


def rival(text: str, spans: dict[int, list[tuple[int, int]]], at: int, new: str) -> tuple[int, str, bool]:
    """The pair, and the text by it, that makes most sense of a span: the one with the fewest uncommon characters; false if another one has as few and no kana decides."""
    true, wrong = PAIRS[at]
    if true not in ("euc_jp", "cp932", *RIVALS) or wrong not in ("sloppy_1252", "latin-1"):
        return at, new, True
    tried = [(rare(new, true), 0, at, new)]
    for other in RIVALS:
        if (pair := (other, wrong)) in PAIRS and other != true:
            k = PAIRS.index(pair)
            made, done = respell(text, k, spans[at])
            if done:
                tried.append((rare(made, other), 1, k, made))
    tried.sort()
    clear = len(tried) == 1 or tried[0][0] < tried[1][0] or any(map(is_kana, tried[0][3]))
    return tried[0][2], tried[0][3], clear


def inspect(text: str | None) -> tuple[bool, str | None, str | None]:
    """Whether a text is garbled, the restored text (None if sound or beyond repair) and the encodings that were confused."""
    if not text or text.isascii() and "$" not in text and "\x1b" not in text:
        return False, None, None
    now, shifts, proved, whole = unshift(text)
    garbled, how = shifts or LOST in text or bool(BROKEN.search(text)), [SHIFTS] if shifts else []
    while True:  # each layer undone leaves fewer characters
        spans = {at: v for at, v in spans_of(now).items() if not (PAIRS[at][1] in WIDE and "/".join(PAIRS[at]) in how)}
        tried = [(respell(now, at, v), at) for at, v in spans.items()]
        # the pair that explains most characters, and of those the one that leaves the shortest text
        tried = sorted((-done, len(new), at, new) for (new, done), at in tried)
        if not tried:
            break
        garbled = True
        if not tried[0][0] or tried[0][3] == now:
            break
        at, new, clear = rival(now, spans, tried[0][2], tried[0][3])
        whole = whole and clear
        if len(new) >= len(now):
            if new != now and not any("/".join(PAIRS[at]) == h for h in how):
                now = new
                how.append("/".join(PAIRS[at]))
                continue
            break
        now = new
        how.append("/".join(PAIRS[at]))
    if lone := lone_letters(now):
        garbled = True
        letter = now[slice(*lone[0])]
        for at, (true, wrong) in enumerate(PAIRS):
            if true in ("latin-1", "euc_jp", "utf-8") and to_bytes(letter, wrong):
                new, done = respell(now, at, lone)
                if done and new != now and not lone_letters(new) and SOUND.fullmatch(new):
                    now = new
                    how.append("/".join(PAIRS[at]))
                    break
    mended = garbled and how and whole and all(c in proved or SOUND.fullmatch(c) for c in FOREIGN.sub("", now)) and not spans_of(now) and not lone_letters(now) and not REST.search(now)
    return garbled, now if mended else None, "; ".join(how) or None


@functools.lru_cache(maxsize=100_000)
def inspected(text: str) -> tuple[bool, str | None, str | None]:
    """Names come again and again; each worker keeps those that it has seen last."""
    return inspect(text)


def garbled_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, original, restored, confused``: one row for each garbled value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            ids = b.column(key).to_pylist()
            for f in fields:
                for i, text in zip(ids, b.column(f).to_pylist()):
                    bad, restored, how = inspect(text) if text is None or len(text) > 200 else inspected(text)
                    if bad:
                        for column, v in zip(out, (i, f, text, restored, how)):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(c, pa.string()) for c in out[1:]]], names=[key, "field", "original", "restored", "confused"])

    return rows.select(key, *fields).mapInArrow(run, f"{key} bigint, field string, original string, restored string, confused string")
