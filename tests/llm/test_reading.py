from __future__ import annotations

import pyarrow as pa

from taxoflow.llm import queries as Q
from taxoflow.llm import reading as R
from taxoflow.llm.codepoints import Words

EASY = "The cat sat on a mat. I see a dog. He ran to me. We had a bun. "
HARD = "Notwithstanding considerable methodological heterogeneity, interdisciplinary investigations of environmental decontamination necessitate comprehensive statistical characterization throughout institutional jurisdictions. "


def test_own_words():
    quote = "alice wrote:\n> " + HARD + "\n\n"
    assert HARD[:20] not in R.own_words(quote + EASY)
    assert R.own_words("<blockquote>a <blockquote>b</blockquote> c</blockquote>own").split() == ["own"]
    assert R.own_words("[quote=x]a[/quote]own [quote=y]more").split() == ["own", "more"]
    assert R.own_words("own text\n-- \nname\nMotto here.").split() == ["own", "text"]
    assert R.own_words("own text\n____________\nMotto").split() == ["own", "text"]
    assert R.own_words("own text<hr>me | Motto").split() == ["own", "text"]
    assert R.own_words("On 1/2 bob said:\n| " + HARD + "\nown <b>text</b> [url=x]pic[/url]").split() == ["own", "text"]
    assert [R.own_words(x) for x in (None, "", "[deleted]", "<i>post removed</i>", "(message removed by author)")] == [""] * 5


def test_syllables():
    words = {"cat": 1, "make": 1, "table": 2, "apples": 2, "idea": 2, "radio": 3, "nation": 2, "walked": 1, "wanted": 2, "boxes": 2, "university": 5, "the": 1, "rhythm": 1, "created": 3}
    got = dict(zip(words, R.syllables(Words(pa.array(list(words)))).tolist(), strict=True))
    assert sum(got[w] != n for w, n in words.items()) <= 1, got


def test_syllables_of_other_languages():
    for lang, words in {
        "de": {"bauer": 2, "haus": 1, "theater": 3, "museum": 3, "freie": 2, "saal": 1, "boot": 1, "quelle": 2, "liebe": 2, "kühler": 2},
        "fr": {"table": 1, "tables": 1, "réalité": 4, "naïf": 2, "parlent": 1, "moment": 2, "eau": 1, "quatre": 1, "beurre": 1},
        "es": {"maíz": 2, "leer": 2, "queso": 2, "aire": 2, "teatro": 3, "día": 2, "puerta": 2, "oído": 3},
    }.items():
        got = dict(zip(words, R.syllables(Words(pa.array(list(words))), lang).tolist(), strict=True))
        assert got == words, lang


def test_grades_and_levels(spark, rows):
    docs = [(i, (EASY if i % 2 else HARD) * (1 + i % 4), "x") for i in range(40)] + [(100, None, "x"), (101, "", "x"), (102, "Too short.", "x"), (103, EASY * 20_000, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, id string")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 4) for i in range(20)] + [(0, 3), (999, 2), (1, None)], "doc_id long, read_level int")
    got = {r.id: r.level for r in R.reading_levels(d, labels).collect()}
    assert all(got[i] == (1 if i % 2 else 4) for i in range(40))
    assert [got[i] for i in (100, 101, 102, 103)] == [None, None, None, 1]
    assert {r.level for r in R.reading_levels(d, labels.limit(0)).collect()} == {None}
    assert R.reading_levels(d.limit(0), labels).count() == 0


def test_cuts():
    pts = [(x, 1) for x in (1, 2, 3)] + [(x, 2) for x in (6, 7, 3.5)] + [(x, 3) for x in (11, 12)] + [(20, 4), (6.5, 1)]
    a, b, c = R.fit_cuts(pts)
    assert 3 < a < 3.5 and 7 < b < 11 and 12 < c < 20


def test_profile_has_posts_of_every_language(spark, tmp_path):
    docs = [(i, (EASY if i % 2 else HARD) * 3, "en", "s") for i in range(10)] + [(10, EASY * 3, "de", "s"), (11, HARD * 3, None, "s"), (12, None, "fr", None), (13, HARD * 3, "es", " S")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 if i % 2 else 4) for i in range(8)], "doc_id long, read_level int").write.parquet(f"{tmp_path}/reading_labels.parquet")
    got = {(r.source, r.lang, r.level): r.n_docs for r in Q.p8_profile(spark, str(tmp_path)).collect()}
    assert got == {("s", "en", 1): 5, ("s", "en", 4): 5, ("s", "de", 1): 1, ("s", None, 4): 1, (None, "fr", None): 1, ("s", "es", 4): 1}
    assert {r.doc_id for r in Q.p8_levels(spark, str(tmp_path)).collect()} == {d[0] for d in docs}
    assert {r.doc_id for r in Q.p8_found(spark, str(tmp_path)).collect()} == {0, 2, 4, 6, 8}
