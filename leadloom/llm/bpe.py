"""Problem 7: the whole corpus as ids of a public byte-level BPE tokenizer.

Merges are replayed over a block of the corpus at once, not word by word: the
distinct words of a block are laid out as linked symbols, an inverted index leads
from each pair of neighbours to its positions, and the merges that occur are applied
in rank order, each touching only the neighbours of its own positions. A word's ids
depend on the word alone, so blocks need no exchange: the query has no shuffle, and
a worker keeps the words that it has already encoded (up to ``memo_words``).

Defined results: an empty text and a null text both have the empty list; strings of
special tokens are ordinary text; texts are never cut, a very long one is split into
words piecewise.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The pattern that splits text before merging; white space as Unicode's White_Space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
TOKENIZERS = "/opt/tokenizers"
LONG_TEXT = 2_000_000


def byte_letters() -> dict[str, int]:
    """Byte of each letter in which byte-level vocabularies are written: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class MergeReplay:
    """Encodes sets of words by replaying the merges of a vocabulary file."""

    def __init__(self, path: str, memo_words: int = 200_000):
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: (left id, right id) -> (rank, id of the merged token)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.ascii, self.any = re.compile(ASCII_WORDS), regex.compile(WORDS)
        self.memo: dict[str, bytes] = {}
        self.memo_words = memo_words

    def replay(self, words: list[str]) -> None:
        """Puts the ids of ``words`` into the memo."""
        symbol, before, after, starts = [], [], [], []
        for w in words:
            data = w.encode("utf-8", "surrogatepass")
            at = len(symbol)
            starts.append(at)
            symbol += [self.first[b] for b in data]
            before += range(at - 1, at + len(data) - 1)
            after += range(at + 1, at + len(data) + 1)
            if data:
                before[at] = after[-1] = -1
        merges, index, ranks = self.merges, {}, []

        def note(left: int, right: int) -> None:
            pair = (symbol[left], symbol[right])
            held = index.get(pair)
            if held is not None:
                held.append(left)
            elif (found := merges.get(pair)) is not None:
                index[pair] = [left]
                heapq.heappush(ranks, (found[0], pair))

        for i, j in enumerate(after):
            if j >= 0:
                note(i, j)
        while ranks:
            _, pair = heapq.heappop(ranks)
            a, b = pair
            merged = merges[pair][1]
            for i in sorted(index.pop(pair)):
                j = after[i]
                if symbol[i] != a or j < 0 or symbol[j] != b:
                    continue  # taken by an earlier merge
                symbol[i], symbol[j] = merged, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    note(i, k)
                if before[i] >= 0:
                    note(before[i], i)
        starts.append(len(symbol))
        for w, at, end in zip(words, starts, starts[1:]):
            self.memo[w] = np.array([s for s in symbol[at:end] if s >= 0], dtype=np.int32).tobytes()

    def split(self, text: str) -> Iterator[list[str]]:
        pattern = self.ascii if text.isascii() else self.any
        if len(text) < LONG_TEXT:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while part := list(islice(found, LONG_TEXT // 8)):
            yield part

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as int32 bytes."""
        out: list[bytes] = []
        if len(self.memo) > self.memo_words:
            self.memo.clear()
        words = [[] if not t else next(self.split(t)) if len(t) < LONG_TEXT else None for t in texts]
        new = set().union(*(w for w in words if w)) - self.memo.keys()
        if new:
            self.replay(list(new))
        of = self.memo.__getitem__
        for t, w in zip(texts, words):
            if w is not None:
                out.append(b"".join(map(of, w)))
                continue
            parts = []
            for part in self.split(t):
                if new := set(part) - self.memo.keys():
                    self.replay(list(new))
                parts.append(b"".join(map(of, part)))
            out.append(b"".join(parts))
        return out


@functools.lru_cache(maxsize=2)
def replayer(path: str) -> MergeReplay:
    """One encoder for each worker process and vocabulary."""
    return MergeReplay(path)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their text stays near ``most`` bytes, whatever the length of single texts."""
    for batch in batches:
        size = batch.num_rows and max(1, batch.column(batch.schema.get_field_index(column)).nbytes)
        step = max(1, int(batch.num_rows * most / size)) if size else 1
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def encode_table(rows: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id`` and ``ids`` of ``doc_id, text``."""
    path = f"{folder}/{tokenizer}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            ids = replayer(path).encode(b.column("text").to_pylist())
            ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(rows: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, source, n_tokens`` of ``doc_id, source, text``."""
    path = f"{folder}/{tokenizer}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            n = [len(x) // 4 for x in replayer(path).encode(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return rows.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")
