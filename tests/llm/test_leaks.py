from __future__ import annotations

import random

import pyarrow as pa
import pytest

from taxoflow.llm import leaks


def _runs(text):
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {tuple(w[i : i + leaks.RUN]) for i in range(len(w) - leaks.RUN + 1)}


@pytest.mark.parametrize("pair_words", [0, 200_000])
def test_against_plain_search(monkeypatch, pair_words):
    monkeypatch.setattr(leaks, "PAIR_WORDS", pair_words)
    rng = random.Random(4)
    vocab = ["a", "bee", "Cod", "d", "e-f", "g.", "h", "éa"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 60)))) for i in range(30)]
    docs = []
    for _ in range(200):
        words = [rng.choice(vocab) for _ in range(rng.randrange(80))]
        src = rng.choice(items)[1].upper().split()
        a = rng.randrange(len(src))
        words[10:10] = src[a : a + rng.randrange(10, 25)]
        docs.append("\n> ".join(words))
    want = {(r, i) for r, d in enumerate(docs) for i, s in items if _runs(d) & _runs(s)}
    assert set(leaks.Patterns(items).find(pa.array(docs))) == want
    assert want


def test_documents(spark, rows, monkeypatch):
    p = " ".join(f"word{i}" for i in range(40))
    text = p.split()
    docs = [
        (1, "So: " + " ".join(text[3:18]).upper(), 0), (2, " ".join(text[3:17]), 0), (3, "> " + "\n> ".join(text[5:30]), 0), (4, "<b>" + "</b>&nbsp;<br>".join(text[:16]), 0), (5, None, 0), (6, "", 0),
        (7, "[quote=x]" + " ".join(text[8:15]) + "[/quote] &amp; " + " ".join(text[15:25]), 0), (8, "y " * 300_000 + p, 0), (9, " ".join(text[:7] + ["other"] + text[7:16]), 0), (1, " ".join(text[3:18]), 0), (10, " ".join("w<i>or</i>d" + t[4:] for t in text[:15]), 0),
    ]
    items = [(100, p, None), (101, "short one", p), (102, None, None), (103, " ".join(text[:14]), "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, passage string, question string")
    want = [(k, x) for k in (1, 1, 3, 4, 7, 8, 10) for x in (100, 101)]
    assert rows(leaks.leaked_items(d, i)) == sorted(want)
    monkeypatch.setattr(leaks, "TABLE_LETTERS", 200)  # several passes
    monkeypatch.setattr(leaks, "PAIR_WORDS", 10)
    assert rows(leaks.leaked_items(d, i)) == sorted(want)
    assert leaks.leaked_items(d.limit(0), i).count() == 0
    assert leaks.leaked_items(d, i.limit(0)).count() == 0
