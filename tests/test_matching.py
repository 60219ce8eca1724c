"""Cleaning and matching of small samples with small lexicons."""

from __future__ import annotations

import argparse

import pytest
from pyspark.sql import functions as F

from taxoflow.functions import text as T
from taxoflow.operators import classify, cleaning, lexicon, matching
from taxoflow.sources import samples as S

TERMS = [
    ("uberon_1", "breast"), ("pato_1", "frozen"), ("envo_1", "cerebrospinal fluid"), ("ncbitaxon_1", "Salmonella enterica"), ("uberon_2", "gastric vein"), ("uberon_3", "manual digit"),
    ("uberon_4", "proximal phalanx"), ("chebi_1", "salt"), ("envo_2", "table"), ("foodon_1", "Cabbage food product"), ("envo_3", "field"), ("foodon_2", "field crop"),
]
LEX = lexicon.Lexicon(
    abbreviations={"fld": "fluid", "csf": "cerebrospinal fluid"}, non_english={"aam": "mango"}, spelling={"desicated": "desiccated"}, exceptions={"cornflakes": ""},
    stop_words={x: "" for x in ("by", "of", "been", "do", "a")}, scientific={"chicken": "gallus gallus", "mango": "mangifera indica"},
)


@pytest.fixture(scope="module")
def table(spark):
    terms = spark.createDataFrame([(t, l, i) for i, (t, l) in enumerate(TERMS)], "term_id string, label string, pos int")
    syn = spark.createDataFrame([("kohl", "cabbage"), ("brain water", "cerebrospinal fluid")], "syn string, std string")
    return lexicon.match_table(lexicon.labels_of(terms), syn)


@pytest.fixture(scope="module")
def match(spark, table):
    def run(*texts):
        rows = spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "row_key long, sample_id string, sample_desc string")
        out = matching.match_samples(cleaning.clean_samples(rows, LEX), table)
        return [r.line.split("\t")[2:] for r in S.render(out, full=True).orderBy("row_key").collect()]

    return run


def test_rows(match):
    got = match(
        "Chicken Breast", "csf fld", "by", "been does", "enterica Salmonella", "proximal epiphysis of manual digit 1 proximal phalanx of", "vein gastric", "cabbage", "kohl", "brain water", "aam milkshake", None, "tables salt", "Cornflakes",
    )
    assert got[0] == ["chicken breast", "chicken {gallus gallus} breast", "['breast:UBERON_1']", "Component Match", "[\"{breast: ['A Direct Match']}\"]", "{}"]
    assert got[1][:4] == ["cerebrospinal fluid", "cerebrospinal fluid", "['cerebrospinal fluid:ENVO_1']", "Full Term Match"]
    assert got[1][4] == str(["Used Cleaned Sample", "Abbreviation-Acronym Treatment: cerebrospinal fluid", "Abbreviation-Acronym Treatment: fluid", "A Direct Match"])
    assert got[2] == ["", "by", "[]", "No Match", "[]", "{}"]
    assert got[3] == ["", "been do", "[]", "No Match", "['Inflection (Plural) Treatment: does']", "{'does': 'do'}"]
    assert got[4][2:5] == ["['salmonella enterica:NCBITAXON_1']", "Component Match", "[\"{salmonella enterica: ['A Direct Match']}\"]"]
    assert got[5][0] == "proximal epiphysi manual digit phalanx"
    assert got[5][2] == "['manual digit:UBERON_3', 'proximal phalanx:UBERON_4']"
    assert got[6][2:5] == ["['gastric vein:UBERON_2']", "Full Term Match", "['Permutation of Tokens in Resource Term']"]
    assert got[7][2:5] == ["['cabbage food product:FOODON_1']", "Full Term Match", "['Suffix Addition', 'A Direct Match']"]
    assert got[8][4] == "['Synonym Usage', 'Suffix Addition', 'A Direct Match']"
    assert got[9][4] == "['Synonym Usage', 'A Direct Match']"
    assert got[10][1] == "mango {mangifera indica} milkshake"
    assert got[11] == ["", "", "[]", "No Match", "[]", "{}"]
    assert got[12][2] == "['salt:CHEBI_1', 'table:ENVO_2']"
    assert got[13][0] == "cornflakes"


def test_ancestors_are_dropped(spark):
    m = spark.createDataFrame([(1, [("a", "x1", ["s"]), ("b", "x2", ["s"])])], f"row_key int, components array<{matching.MATCH}>")
    up = spark.createDataFrame([("x2", ["x1", "x0"])], "node string, ancestors array<string>")
    assert [r.kept[0].id for r in matching.drop_ancestors(m, up).collect()] == ["x2"]


def test_last_wins_and_merge(spark, rows):
    df = spark.createDataFrame([("a", "1", 0), ("b", "2", 1), ("a", "3", 2)], "key string, val string, pos int")
    assert rows(lexicon.last_wins(df)) == [("a", "3", 0), ("b", "2", 1)]
    one = spark.createDataFrame([("k", "a", "1"), ("k", "b", "1")], "kind string, key string, val string")
    two = spark.createDataFrame([("k", "b", "2"), ("k", "c", "2")], "kind string, key string, val string")
    assert rows(lexicon.merge_lookups(one, two)) == [("k", "a", "1"), ("k", "b", "2"), ("k", "c", "2")]
    assert lexicon.merge_mappings({"x": {"a": 1}}, {"x": {"a": 2, "b": 3}}) == {"x": {"a": 2, "b": 3}}
    for bad in ({"y": {}}, {"x": 1}):
        with pytest.raises(ValueError):
            lexicon.merge_mappings({"x": {}}, bad)


def test_sample_files(spark, tmp_path, rows):
    p = tmp_path / "in.csv"
    p.write_text('SampleId,Sample,,More\n s1 ,"a, b",c,d\n\ns2\n"s3", x \n')
    assert [(r.sample_id, r.sample_desc) for r in S.read_samples(spark, str(p)).orderBy("row_key").collect()] == [("s1", "a, b c d"), ("s2", ""), ("s3", "x")]
    t = tmp_path / "in.tsv"
    t.write_text("SampleId\tSample\ns1\ta, b\n")
    assert [(r.sample_id, r.sample_desc) for r in S.read_samples(spark, str(t)).collect()] == [("s1", "a, b")]
    with pytest.raises(argparse.ArgumentTypeError):
        S.input_path("x.txt")
    with pytest.raises(FileNotFoundError):
        S.input_path("nothing.csv")


def test_empty_file_gives_header(spark, tmp_path, table):
    p = tmp_path / "empty.csv"
    p.write_text("SampleId,Sample\n")
    out = tmp_path / "out.tsv"
    S.write_tsv(matching.match_samples(cleaning.clean_samples(S.read_samples(spark, str(p)), LEX), table), str(out))
    assert out.read_text() == "\t".join(S.BASE) + "\n"
    assert len(S.output_columns(True, True)) == 12
    assert len(S.output_columns(False, True)) == 7


def test_command_line(tmp_path):
    from taxoflow import cli

    p = tmp_path / "in.csv"
    p.write_text("SampleId,Sample\n1,Frozen Breast\n2,table\n")
    folder = tmp_path / "res"
    folder.mkdir()
    (folder / "terms.csv").write_text("id,label\npato_1,Frozen\nenvo_2,Table\n")
    out = tmp_path / "out.tsv"
    cli.main([str(p), "-r", str(folder), "-o", str(out)])
    assert out.read_text().split("\n")[1:3] == ["1\tFrozen Breast\tfrozen breast\tfrozen breast\t['frozen:PATO_1']\tComponent Match", "2\ttable\ttable\ttable\t['table:ENVO_2']\tFull Term Match"]


def test_profile_and_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('[{"a.owl": ""}, {"b.owl": "http://x/Root"}]')
    assert S.read_config(str(p)) == [(2, "a.owl", "http://www.w3.org/2002/07/owl#Thing"), (1, "b.owl", "http://x/Root")]
    assert S.with_profile(S.Options(output="mine"), {"output": "other", "bucket": "True"}) == S.Options(output="mine", bucket=True)
    before = S.cache_key(str(p))
    p.write_text("[]")
    assert S.cache_key(str(p)) != before


def test_buckets_and_defaults(spark, rows):
    paths = spark.createDataFrame([("a", ["a", "b", "c"]), ("a", ["a", "d"])], "node string, path array<string>")
    buckets = spark.createDataFrame([("c", "C", 0), ("b", "B", 1), ("b", "B2", 2)], "term_id string, label string, pos int")
    levels = classify.path_levels(paths, buckets)
    assert rows(levels) == [("a", "a/b/c", 2, "b", "B2"), ("a", "a/b/c", 3, "c", "C")]
    nearest = classify.nearest_buckets(levels)
    labels = spark.createDataFrame([("b", "y;x"), ("zz", "q")], "bucket_id string, label string")
    assert rows(classify.bucket_classes(nearest, labels)) == [("a", ["x", "y"])]
    s = spark.createDataFrame([(1, "Frozen raw chickens"), (2, "cow"), (3, None)], "k int, t string")
    phrases = spark.createDataFrame([("chicken", "poultry", 0), ("frozen chicken", "frozen", 1), ("raw-chick", "odd", 2)], "phrase string, label string, pos int")
    assert rows(classify.default_classes(s, phrases, key="k", text="t")) == [(1, "frozen chicken", "frozen")]
    assert rows(classify.refining_labels(s, phrases, key="k", text="t")) == []
    plain = spark.createDataFrame([(1, "Raw_chicken, frozen"), (2, "un-raw chickens"), (3, "raw-chick")], "k int, t string")
    assert rows(classify.refining_labels(plain, phrases, key="k", text="t")) == [(1, "chicken", "poultry")]


def test_rules(spark):
    rules = [
        classify.Rule(has=("clinical",), some=(("plant", "animal"),), no_text=("swab",), remove=("clinical",)),
        classify.Rule(exactly=("nut", "seeds"), remove=("seeds",)),
        classify.Rule(has=("feed",), keep=("feed",)),
        classify.Rule(text=("swab sub",), clear=True, add=("environmental",)),
        classify.Rule(size=3, lacks=("feed",), add=("multi",)),
    ]
    data = [(["clinical", "plant"], "leaf"), (["clinical", "plant"], "leaf swab"), (["seeds", "nut"], "x"), (["feed", "cow"], "x"), (["a", "b"], "swab sub 1"), (["a", "b", "c"], ""), (None, "x")]
    df = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(data)], "i int, a array<string>, t string")
    got = [r[0] for r in df.orderBy("i").select(classify.apply_rules(F.col("a"), F.col("t"), F.split("t", " "), rules)).collect()]
    assert got == [["plant"], ["clinical", "plant"], ["nut"], ["feed"], ["environmental"], ["a", "b", "c", "multi"], []]


def test_stream(spark, tmp_path, table):
    from taxoflow.plans.pipeline import Resources
    from taxoflow.streaming.match_stream import match_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("s1,frozen breast\ns2,nothing\n")
    q = match_stream(S.stream_samples(spark, str(folder)), Resources(LEX, table), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("sample_id", T.py_list(F.col("matched"))).collect()
    assert sorted(map(tuple, got)) == [("s1", "['breast:UBERON_1', 'frozen:PATO_1']"), ("s2", "[]")]


def test_classified_rows(tmp_path):
    from taxoflow import cli

    (tmp_path / "in.csv").write_text("SampleId,Sample\n1,table\n2,odd chickens\n3,nothing\n")
    files = {
        "terms.csv": "id,label\nenvo_2,Table\n", "buckets.csv": "l,i\nfurniture,ENVO:2\n", "third_buckets.csv": "l,i\nitem,envo_2\n", "third_labels.csv": "i,l\nenvo_2,wood;house\n",
        "default_classes.csv": "p,l\nchicken,poultry\n", "refining_classes.csv": "p,l\nodd,strange\n", "priority_classes.csv": "l\nwood\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    cli.main([str(tmp_path / "in.csv"), "-r", str(tmp_path), "-o", str(tmp_path / "out.tsv"), "-f", "-b"])
    got = [x.split("\t")[-4:] for x in (tmp_path / "out.tsv").read_text().split("\n")[1:4]]
    assert got[0] == ["[{1: {'envo_2': 'furniture'}}]", "[{'envo_2': 'furniture'}]", "[{'envo_2': 'item'}]", "['wood', 'house']"]
    assert got[1] == ["[]", "[]", "['Default classification']", "['poultry', 'strange']"]
    assert got[2] == ["[]", "[]", "[]", "[]"]


def test_result_log(spark, tmp_path, rows):
    p = tmp_path / "log.tsv"
    p.write_text("h\th\n1\tCow\t{'Cow':'X_1'}\tAnimal, 2 : Beef\tBEEF\n2\tnone\tx\n3\tHam\t['a', 'b:Y']\t[{3: 'fault'}]\tPork, Meat\n1\tCow\tx\ty\tz\n")
    assert rows(S.read_result_log(spark, str(p))) == [("1", "Cow", [], ["y"], ["z"]), ("3", "Ham", ["a", "b:y"], ["fault"], ["pork", "meat"])]
