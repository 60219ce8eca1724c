from __future__ import annotations

import random

import numpy as np

from taxoflow.llm import canonical as C

TERMS = [("fdx_00000001", "Carrot"), ("fdx_00000002", "salted carrot juice"), ("fdx_00000003", "Rabbit"), ("anx_00000004", "barn drain swab"), ("fdx_00000005", "turkey"), ("fdx_00000006", "Cassava broth"), ("fdx_00000007", "Beef"), ("fdx_00000008", "beet"), ("fdx_00000009", "Carrot  "), (None, "x"), ("fdx_00000010", None)]
LEXICON = [("abbreviation", 1, " CRT", "turkey"), ("abbreviation", 5, "crt ", "carrot"), ("abbreviation", 2, "cssv", "cassava"), ("non_english", 3, "kaninchen", "rabbit"), ("synonym", 1, "Old Barn", "carrot"), ("synonym", 9, "old barn ", "barn drain swab"), ("synonym", 2, "lost", "no such label"), ("stopword", 1, "The", None), ("stopword", 1, "of", None), (None, 1, None, None)]


def _index():
    return C.Mapper(TERMS, C.Lexicon(LEXICON))


def _meant(values):
    out = {v: set() for v in values}
    for i, t, _ in _index().match(values):
        out[values[i]].add(t)
    return out


def test_spellings():
    both = {"fdx_00000001", "fdx_00000009"}
    right = {
        "CARROTS": both, "the carrot?": both, "carot": both, "crt": both, "carrot lot 12/a": both, "36 x carrot (approx 7 kg)": both, "carrot 6/4/2023": both, "sample of carrot #4": both, "c4rrot": both,
        "juice, carrot; salted": {"fdx_00000002"}, "saltedcarrot juice": {"fdx_00000002"}, "salted crt juise": {"fdx_00000002"}, "old barn": {"anx_00000004"}, "kaninchen": {"fdx_00000003"}, "kninchen": {"fdx_00000003"},
        "c a r r o t": both, "sal ted car rot juice": {"fdx_00000002"}, "juicecarrotsalted": {"fdx_00000002"}, "turk ey": {"fdx_00000005"},
        "cssvbroth": {"fdx_00000006"}, "whatever FDX:00000005": {"fdx_00000005"}, "ANX 00000004": {"anx_00000004"}, "beet": {"fdx_00000008"}, "beef": {"fdx_00000007"}, "swab barn drain": {"anx_00000004"},
    }
    got = _meant(list(right))
    assert {k: v for k, v in got.items() if v != right[k]} == {}


def test_no_entry():
    values = ["carrot juice", "salted carrot juice jar", "harmonica", "lost", "12 kg", "fdx_99999999", "carrot turkey", "?", "beex"]
    assert all(not v for v in _meant(values).values())


def test_candidates_against_all_cosines():
    """Grams that are not read lose no candidate."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    terms = [(f"t{i}", " ".join(rng.sample(words, rng.randrange(1, 5)))) for i in range(400)]
    ix = C.Mapper(terms, C.Lexicon([])).index
    bags = [ix.grams(rng.sample(words, rng.randrange(1, 5)) + ["zzq"] * (i % 3 == 0)) for i in range(80)] + [C.Counter()]
    vec = lambda b: {g: n * (ix.idf[ix.gram_no[g]] if g in ix.gram_no else ix.new_idf) for g, n in b.items()}
    norm = lambda v: sum(x * x for x in v.values()) ** 0.5 or 1
    names = [vec(ix.grams(n)) for n in ix.names]
    for least in (0.3, 0.7):
        k, n, c = ix.candidates(bags, np.full(len(bags), least))
        got = {(a, b): x for a, b, x in zip(k.tolist(), n.tolist(), c.tolist(), strict=True)}
        for a, q in enumerate(map(vec, bags)):
            for b, m in enumerate(names):
                cos = sum(x * m.get(g, 0) for g, x in q.items()) / norm(q) / norm(m)
                assert abs(cos - least) < 1e-6 or ((a, b) in got) == (cos >= least)
                assert (a, b) not in got or abs(got[a, b] - cos) < 1e-9


def test_swapped_letters_are_nearer():
    m = C.Mapper([("t_1", "pecan"), ("t_2", "peach")], C.Lexicon([]))
    assert [t for _, t, _ in m.match(["peacn", "pecah", "peacj", "peca"])] == ["t_1", "t_2", "t_2", "t_1"]


def test_one_slip():
    assert all(C.within_one(a, b) for a, b in [("ab", "ab"), ("ab", "ba"), ("abc", "abd"), ("abc", "ac"), ("ac", "abc"), ("", "a")])
    assert not any(C.within_one(a, b) for a, b in [("abc", "cba"), ("ab", "cd"), ("a", "abc"), ("abcd", "badc")])


def test_tables(spark, rows, monkeypatch):
    results = spark.createDataFrame([(1, "Carots", ["rabbit:FDX_00000003", None, "", "harmonica"], "x"), (2, None, None, "x"), (3, " ", [], "x"), (1, "carots", ["RABBIT"], "x"), (4, "Harmonica", None, "x")], "result_id long, sample string, matched_components array<string>, value string")
    terms = spark.createDataFrame([t for t in TERMS if t[0] != "fdx_00000009"], "term_id string, label string")
    lexicon = spark.createDataFrame(LEXICON, "kind string, pos int, lex_key string, lex_value string")
    found, unmatched = C.map_results(results, terms, lexicon)
    want = [(1, "matched_components", "fdx_00000003"), (1, "sample", "fdx_00000001")]
    assert rows(found) == want
    assert rows(unmatched) == [(1, "matched_components", "harmonica"), (4, "sample", "Harmonica")]
    monkeypatch.setattr(C, "NAMES_AT_ONCE", 4)
    assert rows(C.map_results(results, terms, lexicon)[0]) == want
    assert rows(C.map_results(results, terms, lexicon, filler=("harmonica",))[0]) == want
    assert C.map_results(results, terms.limit(0), lexicon)[0].count() == 0
    assert C.map_results(results.limit(0), terms, lexicon)[0].count() == 0


def test_parts_of_a_list_give_what_the_whole_gives(spark, rows, monkeypatch):
    names = ["apple", "apply", "beef", "beet", "carrot", "parrot", "salted beef", "salted beet", "bread crumb", "beef", "turkey wing", "cassava"]
    terms = spark.createDataFrame([(f"fdx_{i:08}", n) for i, n in enumerate(names)], "term_id string, label string")
    values = ["beef", "beet", "beex", "karrot", "apply", "appl", "apple", "carrot", "parrot", "salted beet", "salted beex", "bread crumbs", "beet fdx_00000004", "crt", "old barn", "the turkey wing", "cassava 12 kg", "turkey"]
    results = spark.createDataFrame([(i, v, []) for i, v in enumerate(values)], "result_id long, sample string, matched_components array<string>")
    lexicon = spark.createDataFrame(LEXICON, "kind string, pos int, lex_key string, lex_value string")
    want = rows(C.map_results(results, terms, lexicon)[0])
    assert [t for i, _, t in want if i < 7] == ["fdx_00000002", "fdx_00000009", "fdx_00000003", "fdx_00000001", "fdx_00000000"]  # 'beex', 'karrot' and 'appl' are ambiguous
    for n in (1, 3):
        monkeypatch.setattr(C, "NAMES_AT_ONCE", n)
        assert rows(C.map_results(results, terms, lexicon)[0]) == want
