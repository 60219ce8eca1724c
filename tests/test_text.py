"""Text expressions against facts about them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from taxoflow.functions import text as T


@pytest.fixture(scope="module")
def of(spark):
    """of(function, values): the function's results for the values."""

    def run(function, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v " + ("array<string>" if isinstance(values[0], list) else "string"))
        return [r[0] for r in df.orderBy("i").select(function(F.col("v")).alias("x")).collect()]

    return run


def test_numbers(of):
    assert of(T.is_number, ["0", "1.5", "-1.5", "nan", "1e5", "1_0", "½", "", "foo", "1d", None]) == [True] * 7 + [False] * 4


def test_dates(of):
    assert of(T.is_date, ["2018-05-07", "12/22/78", "July 1st, 2008", "10", "1st", "10am", "may", "sun", "", "foo", "of", "day", "5g", None]) == [True] * 8 + [False] * 6


def test_preprocess(of):
    got = of(T.preprocess_token, ["cow", "cow's", "cow's and chicken's", "cow, ", "cow, horse, and goat", "cow. ", "cow. horse. ", "cow's, ", "cow's. , ", "cow's, . "])
    assert got == ["cow", "cow", "cow and chicken", "cow", "cow, horse, and goat", "cow", "cow. horse", "cow", "cow", "cow,"]


def test_punctuation(of):
    assert of(T.punctuation_treatment, ["_foo-bar_", "_foo;ba r_", "a-b -1", "a  b", None]) == ["foo bar", "foo ba r", "a b 1", "a b", None]


def test_ngrams(of):
    assert of(lambda c: T.ngrams(c, 1), ["", "hello world!"]) == [[[""]], [["hello"], ["world!"]]]
    assert of(lambda c: T.ngrams(c, 2), ["hello world!", "why, hello world!", "one"]) == [[["hello", "world!"]], [["why,", "hello"], ["hello", "world!"]], []]


def test_combinations(of):
    assert of(lambda c: T.gram_positions(c, 2), [["a", "b", "c"], ["a"]]) == [[[1, 2], [1, 3], [2, 3]], []]
    long = [str(i) for i in range(15)]
    assert of(lambda c: F.size(T.gram_positions(c, 2)), [long]) == [14]
    assert of(lambda c: F.size(T.gram_positions(c, 2)), [long[1:]]) == [91]


def test_singular(of):
    plural = ["potatoes", "noodles", "does", "as", "epiphysis", "berries", "knives", "boxes", "mice", "men", "sheep", "series", "class", "news"]
    assert of(T.singularize, plural) == ["potato", "noodle", "do", "a", "epiphysi", "berry", "knife", "box", "mouse", "man", "sheep", "series", "class", "news"]
    none = T.Lookup({"cornflakes": ""})
    assert of(lambda c: T.lemma(c, none), ["hummus", "svecia", "cornflakes", "tomatoes"]) == ["hummus", "svecia", "cornflakes", "tomato"]


def test_retain_phrase(of):
    given = [["foo:bar", "foofoo:bar"], ["foo:bar", "foo bar:bar"], ["foo bar hello:world", "foo bar:bar"], ["foo hello:world", "foo bar:bar"], ["foo bar:bar", "foo bar bar:bar"], ["foo:bar", "foo:foo"], []]
    assert of(T.retain_phrase, given) == [["foofoo:bar"], ["foo bar:bar"], ["foo bar hello:world"], ["foo bar:bar", "foo hello:world"], [], ["foo:foo"], []]


def test_duplicates(of):
    assert of(T.dedupe_tokens, ["a b a c b", "chicken gallus gallus x", ""]) == ["a b c", "chicken gallus gallus x", ""]


def test_python_text(of):
    assert of(T.py_string, ["a", "it's", "\"it's\"", "a\tb"]) == [repr(x) for x in ["a", "it's", "\"it's\"", "a\tb"]]
    assert of(T.py_list, [["a", "b's"], []]) == [str(["a", "b's"]), "[]"]


def test_ids(of):
    uris = ["http://purl.org/obo/BFO_0000030", "http://x.org/pizza/pizza.owl#Hot", "http://x.org/a/bc/Term", "local"]
    assert of(T.compact_uri, uris) == ["BFO:0000030", "pizza.owl:Hot", "bc:Term", "local"]
    assert of(T.standard_component, ["shell:uberon_1", "a:b:c"]) == ["shell:UBERON_1", "a:B"]
    prefixes = T.Lookup({"BFO": "http://purl.org/obo/BFO_"})
    assert of(lambda c: T.expand_id(c, prefixes), ["BFO:0000030", "zz:1"]) == ["http://purl.org/obo/BFO_0000030", "zz:1"]


def test_labels(of):
    assert of(T.decode_labels, [["a;b", "b", "c"]]) == [["a", "b", "c"]]
    assert of(lambda c: T.priority_first(c, ["y", "z"]), [["b", "z", "y", "a"], ["b", "a"]]) == [["y", "a", "b", "z"], ["a", "b"]]


def test_confidence(of):
    assert of(T.penalty, [["Used Cleaned Sample", "Synonym Usage", "A Direct Match"], []]) == [8, 0]
    levels = of(lambda c: T.confidence_level(c.cast("int")), ["95", "85", "75", "65", "10"])
    assert levels == ["Highest", "High", "Moderately High", "Medium", "Low"]


def test_lookup(of):
    table = T.Lookup({f"k{i}": f"v{i}" for i in range(500)} | {"ü": "u"})
    assert of(table.get, ["k0", "k499", "ü", "none", None]) == ["v0", "v499", "u", None, None]
    with pytest.raises(ValueError):
        T.Lookup({str(i): "" for i in range(T.Lookup.MOST + 1)})


def test_every_plural_rule_has_its_ending():
    import itertools
    import re

    rules = [p for p, _ in T.SINGULAR] + [p + "$" for p, _ in T.IRREGULAR]
    letters = "abehiklmnorstvxyz"
    words = ["".join(w) for n in (1, 2, 3, 4) for w in itertools.product(letters, repeat=n)] + [p + e for p in ("ox", "oxen", "passersb", "octop", "wom", "peopl", "child", "zomb", "sex", "mov", "kin", "hum") for e in ("en", "eny", "y", "i", "e", "ies", "es", "ren", "ans", "a")]
    assert [w for w in words if not re.search(T.ENDINGS, w) and any(re.search("(?i)" + r, w) for r in rules)] == []
