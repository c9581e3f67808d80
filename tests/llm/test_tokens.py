"""Merge replay against the public implementation, and the mixture's guarantees."""

import math
import os
from fractions import Fraction

import numpy as np

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import bpe, mixing

PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def tools():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return bpe.MergeReplay(PATH), t


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'aAé花1\\$")), max_size=80))
def test_like_the_public_implementation(tools, text):
    mine, theirs = tools
    assert np.frombuffer(mine.encode([text])[0], np.int32).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_whole_texts(tools, spark):
    mine, theirs = tools
    texts = [None, "", " ", "<|endoftext|> x", "aaaa" * 1000, "It's 12 we'll\n\n  x", "花が咲く。" * 500, "word " * 500_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as ids")
    got = {r.doc_id: r.ids for r in bpe.encode_table(df).collect()}
    assert got == {i: [] if t is None else theirs.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert bpe.encode_table(df.limit(0)).count() == 0


@pytest.mark.parametrize("shares", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.3, "b": 0.25, "c": 0.15, "d": 0.1, "e": 0.08, "f": 0.07, "g": 0.04}, {"a": 0.123456789, "b": 0.7}, {"a": 1.0}])
def test_schedule_stays_within_one_block(shares):
    weights = mixing.as_weights(shares)
    assert sum(weights.values()) == 1
    plan, used = mixing.slots(weights), dict.fromkeys(weights, 0)
    for t, (s, j) in enumerate(plan, 1):
        assert j == used[s]
        used[s] += 1
        if len(plan) < 5000 or t % 97 == 0:
            assert all(abs(w * t - used[x]) < 1 for x, w in weights.items())
    # a whole period gives the exact weights; where the driver would list too many slots, the first ones are listed
    whole = len(plan) == math.lcm(*(w.denominator for w in weights.values()))
    assert whole or len(plan) == mixing.MOST
    assert all(Fraction(used[s], len(plan)) == w if whole else abs(w * len(plan) - used[s]) < 1 for s, w in weights.items())


def test_mixture_of_weights_with_a_long_period(spark):
    documents = spark.createDataFrame([(i, "ab"[i % 2], f"word number {i} " * 5) for i in range(400)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.123456789, 1), ("b", 0.7, 4)], "source string, target_share double, max_repeats int")
    share = {r.source: r.actual_share for r in mixing.shares(documents, targets, block_tokens=32).collect()}
    assert abs(share["a"] - 0.123456789 / 0.823456789) < 0.002


def test_mixture(spark):
    docs = [(i, "a", f"word number {i} " * (i % 7 + 1), "x") for i in range(300)] + [(1000 + i, "b", "other words " * 5, "x") for i in range(30)] + [(2000, "c", "x", "x"), (2001, None, "y", "x"), (2002, "b", None, "x"), (2003, "b", "", "x")]
    documents = spark.createDataFrame(docs, "doc_id bigint, source string, text string, target_share string")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    got = mixing.mix(documents, targets, block_tokens=32).collect()
    size = {s: sum(r.n_tokens for r in got if r.source == s) for s in "ab"}
    assert abs(size["a"] / sum(size.values()) - 2 / 3) < 0.02 and {r.source for r in got} == {"a", "b"}
    uses = {}
    for r in got:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
    assert max(n for d, n in uses.items() if d < 1000) <= 2 and max(n for d, n in uses.items() if d >= 1000) == 3
    report = {r.source: r for r in mixing.shares(documents, targets, block_tokens=32).collect()}
    assert report["none"].n_tokens == 0 and abs(report["a"].actual_share - 2 / 3) < 0.02
    seen = dict.fromkeys("ab", 0)
    for r in sorted(got, key=lambda r: (r.slot, r.source_offset)):
        seen[r.source] += r.n_tokens
        t = sum(seen.values())
        assert abs(seen["a"] - t * 2 / 3) < 3 * 32 + 60
    assert mixing.mix(documents.limit(0), targets).count() == 0
    assert mixing.mix(documents, targets.limit(0)).count() == 0
    capped = mixing.mix(documents, targets, total_tokens=10**9, block_tokens=32).groupBy("source", "doc_id").count().groupBy("source").agg({"count": "max"}).collect()
    assert {r[0]: r[1] for r in capped} == {"a": 2, "b": 3}
