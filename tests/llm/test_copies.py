from __future__ import annotations

import random
import re

from taxoflow.llm import copies

FIELDS = ["a", "b", "c"]


def _brute(data):
    groups = {}
    for i, *f in data:
        key = tuple(sorted(k for k in (re.sub(r"[\W_]+", "", (x or "").upper().lower()) for x in f) if k))
        if key:
            groups.setdefault(key, []).append(i)
    return groups


def _df(spark, data):
    return spark.createDataFrame([(*r, "x", 0) for r in data], "no long, a string, b string, c string, id string, n int")


def test_cases(spark, rows):
    data = [(5, "Beef, raw", "-", None), (2, None, "BEEF RAW", ""), (9, "beef", "raw", None), (4, "raw", "beef", "?"), (7, "beefraw", None, None), (1, None, "", "--"), (3, None, None, None), (8, "Über-Öl", None, None), (6, "ÜBER ÖL", "", None), (10, "beef" * 200_000, None, None), (11, "BEEF " * 200_000, "", ""), (12, "single", None, None)]
    df = _df(spark, data)
    assert rows(copies.copy_members(df, "no", FIELDS)) == [(2, 2, 3), (4, 4, 2), (5, 2, 3), (6, 6, 2), (7, 2, 3), (8, 6, 2), (9, 4, 2), (10, 10, 2), (11, 10, 2)]
    assert rows(copies.collapse(df, "no", FIELDS)) == [(2, 3), (4, 2), (6, 2), (10, 2), (12, 1)]
    assert copies.copy_members(df.limit(0), "no", FIELDS).count() == 0
    assert copies.collapse(df.limit(0), "no", FIELDS).count() == 0


def test_other_scripts(spark, rows):
    data = [(1, "ΟΔΟΣ Α", None, None), (2, "οδοσα", None, None), (3, "οδος-α", "", None), (4, "ОКУНЬ", None, None), (5, "о.кунь", None, None), (6, "окнуь", None, None), (7, "\u212aelp", None, None), (8, "kelp", None, None), (9, "鱼 干", None, None), (10, "鱼干", None, None), (11, "干鱼", None, None)]
    assert rows(copies.copy_members(_df(spark, data), "no", FIELDS)) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 2), (5, 4, 2), (7, 7, 2), (8, 7, 2), (9, 9, 2), (10, 9, 2)]


def test_random_and_hot_group(spark, rows, monkeypatch):
    rng = random.Random(1)
    words = ["ham", "Ham!", "h-a-m", "cod", "COD", "", None, "-", "ha m"]
    data = [(i, *(rng.choice(words) for _ in range(3))) for i in range(400)] + [(1000 + i, "hot  copy", None, None) for i in range(300)]
    want = {(i, min(g), len(g)) for g in _brute(data).values() if len(g) > 1 for i in g}
    assert {tuple(r) for r in copies.copy_members(_df(spark, data), "no", FIELDS).collect()} == want
    from taxoflow.llm import hot

    monkeypatch.setattr(hot, "HOT_ROWS", 50)  # the groups are now salted
    assert {tuple(r) for r in copies.copy_members(_df(spark, data), "no", FIELDS).collect()} == want
