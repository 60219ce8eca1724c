from __future__ import annotations

import random
import unicodedata

import pyarrow as pa

from taxoflow.llm import visual


def _brute(s):
    size, start, pool, _ = visual._tables()
    return unicodedata.normalize("NFC", "".join("".join(map(chr, pool[start[ord(c)] : start[ord(c)] + size[ord(c)]])) for c in s))


def test_forms():
    given = ["ｃｏｄ　ｒｏｅ", "crème", "crème", "sаlmоn", "sal​mon", "a b", "x‐y", "ﬁsh", "Cod", "c0d", "25 µg", "25 μg", "Kale", "", None, "x²", "1⁄2", "ạ̇", "ạ̇", "́a", "가", "co-op", "co–op"]
    got = visual.unify_arrow(pa.array(given)).to_pylist()
    assert got[:12] == ["cod roe", "crème", "crème", "salmon", "salmon", "a b", "x-y", "fish", "Cod", "c0d", "25 μg", "25 μg"]
    assert got[12:16] == ["Kale", "", None, "x²"]
    assert got[17] == got[18]
    assert got[20] == "가"
    assert got[21] != got[22]
    assert visual.unify_arrow(pa.array([], pa.string())).to_pylist() == []
    assert visual.unify_arrow(pa.array([None], pa.string())).to_pylist() == [None]
    assert visual.unify_arrow(pa.array(given).slice(2, 3)).to_pylist() == got[2:5]


def test_against_plain_code():
    rng = random.Random(2)
    letters = "abȩ̣́̀ аеａ‍éﬃ-‑中\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(3000)]
    assert visual.unify_arrow(pa.array(texts)).to_pylist() == [_brute(t) for t in texts]


def test_every_code_point():
    """A code point and its decomposition come out alike, and composed."""
    given = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    got = visual.unify_arrow(pa.array(given)).to_pylist()
    assert got == visual.unify_arrow(pa.array([unicodedata.normalize("NFD", c) for c in given])).to_pylist()
    assert all(unicodedata.normalize("NFC", x) == x for x in got)
    assert visual.unify_arrow(pa.array(["\U0001d400", "\U0001d5a0", "\U0001d670"])).to_pylist() == ["\U0001d400", "A", "A"]


def test_many_copies_beside_one_variant(spark, monkeypatch):
    from taxoflow.llm import hot

    monkeypatch.setattr(hot, "HOT_ROWS", 100)
    df = spark.range(3000).selectExpr("id as no", "case when id = 5 then 'c\u043ed' when id = 6 then 'cod\u200b' when id > 2990 then concat('x', id) else 'cod' end as text")
    pairs = visual.same_look(df, "no", "text")
    assert pairs.count() == 2 * 2989 + 1
    assert pairs.distinct().count() == 2 * 2989 + 1 and pairs.where("a >= b").isEmpty()


def test_pairs(spark, rows):
    data = [(1, "cod roe", "x"), (2, "cоd roe", "x"), (3, "cod roe", "x"), (4, "cod roe", "x"), (5, "cod", "x"), (6, None, "x"), (7, "Cod roe", "x"), (8, "", "x"), (9, "​", "x")]
    df = spark.createDataFrame(data, "no long, text string, id string")
    assert rows(visual.same_look(df, "no", "text")) == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (8, 9)]
    assert visual.same_look(df.limit(0), "no", "text").count() == 0
    long = spark.createDataFrame([(1, "ａ" * 1_000_000)], "no long, text string")
    assert visual.unify(long, "no", "text").first().unified == "a" * 1_000_000
