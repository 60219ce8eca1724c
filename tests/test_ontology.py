"""Ontologies in RDF/XML, made up here."""

from __future__ import annotations

import pytest

from taxoflow.sources import owl

HEAD = """<?xml version="1.0"?>
<rdf:RDF xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#"
  xmlns:oboInOwl="http://www.geneontology.org/formats/oboInOwl#" xmlns:obo="http://purl.org/obo/">
<owl:Ontology rdf:about="http://x.org/t.owl"><owl:imports rdf:resource="http://x.org/more.owl"/></owl:Ontology>
"""


def _class(name, label, parents=(), extra=""):
    up = "".join(f'<rdfs:subClassOf rdf:resource="http://x.org/TT_{p}"/>' for p in parents)
    return f'<owl:Class rdf:about="http://x.org/TT_{name}">{up}<rdfs:label xml:lang="en">{label}</rdfs:label>{extra}</owl:Class>\n'


@pytest.fixture
def path(tmp_path):
    body = _class("1", "Whole") + _class("2", "Part-One", ["1"], "<oboInOwl:hasExactSynonym>First-Bit</oboInOwl:hasExactSynonym><oboInOwl:hasBroadSynonym>Thing</oboInOwl:hasBroadSynonym>")
    body += _class("3", "Crumb", ["2", "1"], '<rdfs:label xml:lang="pt">Migalha</rdfs:label>') + "<owl:Class><owl:unionOf/></owl:Class>" + _class("9", "Apart")
    p = tmp_path / "t.owl"
    p.write_text(HEAD + body + "</rdf:RDF>")
    (tmp_path / "imports").mkdir()
    (tmp_path / "imports" / "more.owl").write_text(HEAD.replace("<owl:imports rdf:resource=\"http://x.org/more.owl\"/>", "") + _class("4", "Extra", ["3"]) + "</rdf:RDF>")
    return str(p)


def test_tree_and_dimensions(spark, path, rows):
    classes = owl.read_classes(spark, path)
    assert classes.count() == 4
    assert {r.id for r in owl.subclass_tree(classes).collect()} == {"TT:1", "TT:2", "TT:3", "TT:9", "owl:Thing"}
    tree = owl.subclass_tree(owl.read_with_imports(spark, path), ["http://x.org/TT_2"]).cache()
    assert rows(tree.select("id", "label", "parent_id")) == [("TT:2", "Part-One", None), ("TT:3", "Migalha", "TT:2"), ("TT:4", "Extra", "TT:3")]
    terms, synonyms, parents = owl.dimensions([(1, owl.subclass_tree(classes, ["http://x.org/TT_1"]))])
    assert rows(terms.select("term_id", "label")) == [("tt_1", "whole"), ("tt_2", "part-one"), ("tt_3", "migalha")]
    assert rows(synonyms) == [("first bit", "part one")]
    assert rows(parents) == [("tt_2", "tt_1"), ("tt_3", "tt_1"), ("tt_3", "tt_2")]
    assert {(r.node, *sorted(r.ancestors)) for r in owl.ancestor_arrays(parents).collect()} == {("tt_2", "tt_1"), ("tt_3", "tt_1", "tt_2")}


def test_loops_below_the_root(spark, tmp_path, rows):
    body = _class("1", "Whole") + _class("5", "Ay", ["6", "1"]) + _class("6", "Bee", ["5"]) + _class("7", "Under", ["6"]) + _class("8", "Own", ["8", "1"]) + _class("3", "Child", ["8"]) + _class("9", "Apart", ["9"])
    (tmp_path / "l.owl").write_text(HEAD + body + "</rdf:RDF>")
    tree = owl.subclass_tree(owl.read_classes(spark, str(tmp_path / "l.owl")), ["http://x.org/TT_1"])
    terms, _, parents = owl.dimensions([(1, tree)])
    assert rows(terms.select("label")) == [("ay",), ("bee",), ("child",), ("own",), ("under",), ("whole",)]
    got = {r.node: sorted(r.ancestors) for r in owl.ancestor_arrays(parents).collect()}
    assert got == {"tt_5": ["tt_1"], "tt_6": ["tt_1"], "tt_7": ["tt_1", "tt_5", "tt_6"], "tt_8": ["tt_1"], "tt_3": ["tt_1", "tt_8"]}


def test_config_priority(spark, path, rows):
    a = owl.subclass_tree(owl.read_classes(spark, path), ["http://x.org/TT_1"])
    from pyspark.sql import functions as F

    from taxoflow.operators.lexicon import labels_of

    b = a.withColumn("id", F.concat("id", F.lit("b")))
    first = labels_of(owl.dimensions([(2, a), (1, b)])[0])
    assert {r.term_id for r in first.collect()} == {"tt_1", "tt_2", "tt_3"}


def test_no_network():
    with pytest.raises(ValueError):
        owl.resolve("http://x.org/t.owl")


def test_ontology_command(spark, path, tmp_path):
    from taxoflow import cli

    cli.main(["ontology", path, "-r", "http://x.org/TT_2", "-o", str(tmp_path / "out")])
    specs = [(r.id, r.label, r.parent_id) for r in spark.read.json(str(tmp_path / "out/specifications")).collect()]
    assert specs == [("TT:2", "Part-One", None), ("TT:3", "Migalha", "TT:2"), ("TT:4", "Extra", "TT:3")]
    assert spark.read.json(str(tmp_path / "out/ontology")).first().uri == "http://x.org/t.owl"
    cli.main(["ontology", path, "-o", str(tmp_path / "tsv"), "-t"])
    flat = spark.read.csv(str(tmp_path / "tsv/specifications"), sep="\t", header=True).collect()
    assert {r.id: r.synonyms for r in flat}["TT:2"] == "First-Bit|Thing"
