from __future__ import annotations

import os

import pytest

from taxoflow.llm import mixing as M
from taxoflow.llm.queries import TOKENIZER

needs_vocabulary = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file")


def test_fill():
    assert M.fill(10, {"a": 1, "b": 1}, {"a": 2, "b": 100}) == {"a": 2, "b": 8}
    assert M.fill(10, {"a": 1, "b": 1}, {"a": 2, "b": 3}) == {"a": 2, "b": 3}
    assert M.fill(0, {"a": 1}, {"a": 2}) == {"a": 0}
    assert M.fill(10, {"a": 0, "b": 2}, {"a": 5, "b": 20}) == {"a": 0, "b": 10}


def test_shortage_stays_with_siblings_first():
    leaves = [(("x", "de"), 10, 10), (("x", "en"), 30, 90), (("y", "en"), 100, 100)]
    got = M.budgets(leaves, {("x",): 0.5, ("y",): 0.5}, 100).given
    assert got[("x", "de")] == 10 and got[("x", "en")] == 40 and got[("y", "en")] == 50
    got = M.budgets(leaves, {("x",): 0.9, ("y",): 0.1}, 150).given
    assert got[("x", "de")] == 10 and got[("x", "en")] == 90 and got[("y", "en")] == 50
    # the domain weighs what its sources do
    plan = M.budgets([(("x", "a"), 5, 5), (("x", "b"), 100, 100), (("y", "c"), 100, 100)], {("x", "a"): 0.3, ("x", "b"): 0.3, ("y", "c"): 0.4}, 100)
    assert plan.given == {("x", "a"): 5, ("x", "b"): 55, ("y", "c"): 40}
    assert plan.unplaced == {("x", "a"): 25, ("x", "b"): 0, ("y", "c"): 0}


@needs_vocabulary
def test_mix(spark):
    docs = [(i, f"text number {i} " * (1 + i % 3), " Big " if i % 2 else "big", "en" if i % 5 else None, 0) for i in range(300)] + [(1000 + i, "small text here", "small", "en", 0) for i in range(4)] + [(2000, "none at all", None, None, 0), (2001, None, "small", "en", 0), (2002, "", "other", "en", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_tokens int")
    t = spark.createDataFrame([("big", 0.6, 1), ("SMALL ", 0.3, 3), ("absent", 0.1, 5), ("small", 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = M.mix_sources(d, t, tokenizer=TOKENIZER)
    shares = {r.source: r for r in mix.shares.collect()}
    assert {k for k, r in shares.items() if r.short} == {"small", "absent"}
    assert (shares["absent"].docs, shares["absent"].mix_tokens, shares["small"].max_repeats) == (0, 0, 3)
    rows = mix.rows.collect()
    by = {r.doc_id: r for r in rows}
    assert all(by[1000 + i].n_copies == 3 for i in range(4))
    assert max(r.n_copies for r in rows if r.source == "big") == 1
    assert sum(r.n_copies * r.n_tokens for r in rows if r.source == "big") == shares["big"].mix_tokens
    half = M.mix_sources(d, t, tokens=400, tokenizer=TOKENIZER)
    s = {r.source: r for r in half.shares.collect()}
    want = 400 - s["small"].mix_tokens
    assert want - 20 <= s["big"].mix_tokens <= want
    assert {r.doc_id for r in half.rows.collect()} == {r.doc_id for r in M.mix_sources(d, t, tokens=400, tokenizer=TOKENIZER).rows.collect()}
    assert {r.doc_id for r in half.rows.collect()} != {r.doc_id for r in M.mix_sources(d, t, tokens=400, seed=1, tokenizer=TOKENIZER).rows.collect()}
    assert M.mix_sources(d.limit(0), t, tokenizer=TOKENIZER).rows.count() == 0
    assert M.mix_sources(d, t.limit(0), tokenizer=TOKENIZER).shares.count() == 0


@needs_vocabulary
def test_domains_help_their_own_sources_first(spark):
    docs = [(i, "one two three four five six", s, "en") for s, n in (("a", 2), ("b", 60), ("c", 60)) for i in range(n)]
    d = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(docs)], "doc_id long, text string, source string, lang string")
    t = spark.createDataFrame([("a", 0.4, 1, "x"), ("b", 0.2, 1, "x"), ("c", 0.4, 1, "y")], "source string, target_share double, max_repeats int, area string")
    flat = {r.source: r for r in M.mix_sources(d, t, tokens=600, tokenizer=TOKENIZER).shares.collect()}
    tree = {r.source: r for r in M.mix_sources(d, t, tokens=600, tokenizer=TOKENIZER, domain="area").shares.collect()}
    assert (tree["a"].budget, tree["b"].budget, tree["c"].budget) == (12, 348, 240)  # b takes over what a cannot fill
    assert (flat["a"].budget, flat["b"].budget, flat["c"].budget) == (12, 228, 360)
    assert {k for k, r in tree.items() if r.short} == {k for k, r in flat.items() if r.short} == {"a"}


@needs_vocabulary
def test_every_language_is_kept(spark):
    docs = [(i, "some words of a text", "s", f"lang{i % 300}") for i in range(1200)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    t = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    half = M.mix_sources(d, t, tokens=3000, tokenizer=TOKENIZER).rows
    per = {r["lang"]: r["count"] for r in half.groupBy("lang").count().collect()}
    assert len(per) == 300 and set(per.values()) == {2}


@needs_vocabulary
def test_token_counts(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=M.SPLIT, mergeable_ranks=ranks, special_tokens={})
    texts = ["a small text", "", None, "naïve <|endoftext|> x", "word " * 60_000]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.n_tokens for r in M.token_counts(d, tokenizer=TOKENIZER).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
