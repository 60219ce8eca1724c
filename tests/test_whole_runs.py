"""Whole runs through the command line on small lexicons: every area of the result file."""

from __future__ import annotations

import csv

import pytest

# A small lexicon.
FILES = {
    "terms.csv": (
        ("uberon_0000310", "breast"), ("pato_0001985", "frozen"), ("envo_02000029", "cerebrospinal fluid"), ("ncbitaxon_66911", "ameiurus catus"), ("uberon_0006612", "shell"), ("envo_01000584", "table"), ("chebi_24866", "salt"),
        ("uberon_0004450", "gastric vein"), ("uberon_0002389", "manual digit"), ("uberon_0004302", "proximal phalanx"), ("ncbitaxon_28901", "salmonella enterica"), ("po_0009001", "fruit"), ("po_0009010", "seed"), ("chebi_33290", "food"),
        ("bto_0001481", "plant"), ("envo_00000233", "swamp"), ("ancestro_0487", "indian"), ("envo_01000352", "field"),
    ),
    "scientific_names.csv": (("chicken", "gallus gallus"), ("potato", "solanum tuberosum"), ("corn", "zea mays subsp. mays"), ("apple", "malus domestica"), ("mango", "mangifera indica"), ("avocado", "persea americana"), ("cow", "bos taurus")),
    "spelling.csv": (("avocaco", "avocado"), ("desicated", "desiccated"), ("laboratroy", "laboratory"), ("enlish", "english, enlist")),
    "abbreviations.csv": (("fld", "fluid"), ("froz", "frozen"), ("csf", "cerebrospinal fluid"), ("f", "fahrenheit")),
    "non_english.csv": (("aachar", "indian pickle"), ("aam", "mango")),
    "stop_words.csv": (("by", ""), ("of", ""), ("been", ""), ("do", ""), ("a", "")),
    "inflection_exceptions.csv": (("cornflakes", ""), ("hummus", "")),
}
# Text, cleaned, with scientific names, components, macro status, micro status, transformations.
POTATO = ("baked potato", "baked potato {solanum tuberosum}", "[]", "No Match", "[]", "{}")
BREAST = ("breast", "breast", "['breast:UBERON_0000310']", "Full Term Match", "['A Direct Match']", "{}")
CHICKEN_BREAST = ("chicken breast", "chicken {gallus gallus} breast", "['breast:UBERON_0000310']", "Component Match", "[\"{breast: ['A Direct Match']}\"]", "{}")
YOGURT = ("frozen yogurt", "frozen yogurt", "['frozen:PATO_0001985']", "Component Match", "[\"{frozen: ['A Direct Match']}\"]", "{}")
NONE = ("[]", "No Match", "[]", "{}")
SWAMP = ("swamp cabbage plant food source", "swamp cabbage plant a food source", "['food:CHEBI_33290', 'plant:BTO_0001481', 'swamp:ENVO_00000233']", "Component Match", "['Inflection (Plural) Treatment: as', \"{swamp: ['A Direct Match']}\", \"{plant: ['A Direct Match']}\", \"{food: ['A Direct Match']}\"]", "{'as': 'a'}")
SEED = ("anatomical fruit seed part", "anatomical fruit seed part", "['fruit:PO_0009001', 'seed:PO_0009010']", "Component Match", "[\"{fruit: ['A Direct Match']}\", \"{seed: ['A Direct Match']}\"]", "{}")
ROWS = (
    ("Chicken Breast", *CHICKEN_BREAST), ("Baked Potato", *POTATO), ("Canned Corn", "canned corn", "canned corn {zea mays subsp. mays}", *NONE), ("Frozen Yogurt", *YOGURT), ("Apple Pie", "apple pie", "apple {malus domestica} pie", *NONE),
    # punctuation and blanks
    ("Chicken;Breast", *CHICKEN_BREAST), ("Canned_Corn", "canned corn", "canned corn {zea mays subsp. mays}", *NONE), ("Frozen%Yogurt", *YOGURT), ("Baked   Potato", *POTATO),
    # tokens
    ("Baked. Potato's", *POTATO), (" Canned Field Corn's", "canned field corn", "canned field corn {zea mays subsp. mays}", "['field:ENVO_01000352']", "Component Match", "[\"{field: ['A Direct Match']}\"]", "{}"), ("cow's", "cow", "cow {bos taurus}", *NONE),
    # plurals
    ("Svecia", "svecia", "svecia", *NONE), ("Noodles", "noodle", "noodle", "[]", "No Match", "['Inflection (Plural) Treatment: noodles']", "{'noodles': 'noodle'}"), ("Hummus", "hummus", "hummus", *NONE), ("Frosted Cornflakes", "frosted cornflakes", "frosted cornflakes", *NONE),
    ("Mashed potatoes", "mashed potato", "mashed potato {solanum tuberosum}", "[]", "No Match", "['Inflection (Plural) Treatment: potatoes']", "{'potatoes': 'potato'}"), ("Apples", "apple", "apple {malus domestica}", "[]", "No Match", "['Inflection (Plural) Treatment: apples']", "{'apples': 'apple'}"),
    # spelling
    ("desicated avocaco", "desiccated avocado", "desiccated avocado {persea americana}", "[]", "No Match", "['Spelling Correction Treatment: desiccated', 'Spelling Correction Treatment: avocado']", "{'desicated': 'desiccated', 'avocaco': 'avocado'}"),
    ("Pie enlish", "pie english, enlist", "pie english, enlist", "[]", "No Match", "['Spelling Correction Treatment: english, enlist']", "{'enlish': 'english, enlist'}"),
    # abbreviations
    ("Breast", *BREAST), ("fld", "fluid", "fluid", "[]", "No Match", "['Abbreviation-Acronym Treatment: fluid']", "{'fld': 'fluid'}"),
    ("froz fld", "frozen fluid", "frozen fluid", "['frozen:PATO_0001985']", "Component Match", "['Abbreviation-Acronym Treatment: frozen', 'Abbreviation-Acronym Treatment: fluid', \"{frozen: ['A Direct Match']}\"]", "{'froz': 'frozen', 'fld': 'fluid'}"),
    ("csf", "cerebrospinal fluid", "cerebrospinal fluid", "['cerebrospinal fluid:ENVO_02000029']", "Full Term Match", "['Used Cleaned Sample', 'Abbreviation-Acronym Treatment: cerebrospinal fluid', 'A Direct Match']", "{'csf': 'cerebrospinal fluid'}"),
    ("csf f", "cerebrospinal fluid fahrenheit", "cerebrospinal fluid fahrenheit", "['cerebrospinal fluid:ENVO_02000029']", "Component Match", "['Abbreviation-Acronym Treatment: cerebrospinal fluid', 'Abbreviation-Acronym Treatment: fahrenheit', \"{cerebrospinal fluid: ['A Direct Match']}\"]", "{'csf': 'cerebrospinal fluid', 'f': 'fahrenheit'}"),
    ("csf fld", "cerebrospinal fluid", "cerebrospinal fluid", "['cerebrospinal fluid:ENVO_02000029']", "Full Term Match", "['Used Cleaned Sample', 'Abbreviation-Acronym Treatment: cerebrospinal fluid', 'Abbreviation-Acronym Treatment: fluid', 'A Direct Match']", "{'csf': 'cerebrospinal fluid', 'fld': 'fluid'}"),
    # words of other languages
    ("aam aachar", "mango indian pickle", "mango {mangifera indica} indian pickle", "['indian:ANCESTRO_0487']", "Component Match", "['Non English Language Words Treatment: mango', 'Non English Language Words Treatment: indian pickle', \"{indian: ['A Direct Match']}\"]", "{'aam': 'mango', 'aachar': 'indian pickle'}"),
    # stop words
    ("by", "", "by", *NONE), ("been does", "", "been do", "[]", "No Match", "['Inflection (Plural) Treatment: does']", "{'does': 'do'}"), ("does Pie", "pie", "do pie", "[]", "No Match", "['Inflection (Plural) Treatment: does']", "{'does': 'do'}"),
    # whole terms, as they stand, cleaned and in other orders
    ("taco shell's", "taco shell", "taco shell", "['shell:UBERON_0006612']", "Component Match", "[\"{shell: ['A Direct Match']}\"]", "{}"),
    ("tables salt", "table salt", "table salt", "['salt:CHEBI_24866', 'table:ENVO_01000584']", "Component Match", "['Inflection (Plural) Treatment: tables', \"{table: ['A Direct Match']}\", \"{salt: ['A Direct Match']}\"]", "{'tables': 'table'}"),
    ("ameiurus catus", "ameiurus catus", "ameiurus catus", "['ameiurus catus:NCBITAXON_66911']", "Full Term Match", "['A Direct Match']", "{}"),
    ("ameiurus. catus", "ameiurus catus", "ameiurus catus", "['ameiurus catus:NCBITAXON_66911']", "Full Term Match", "['Used Cleaned Sample', 'A Direct Match']", "{}"),
    ("gastric vein", "gastric vein", "gastric vein", "['gastric vein:UBERON_0004450']", "Full Term Match", "['A Direct Match']", "{}"),
    ("proximal epiphysis of manual digit 1 proximal phalanx of", "proximal epiphysi manual digit phalanx", "proximal epiphysi of manual digit phalanx", "['manual digit:UBERON_0002389', 'proximal phalanx:UBERON_0004302']", "Component Match", "['Inflection (Plural) Treatment: epiphysis', \"{proximal phalanx: ['A Direct Match']}\", \"{manual digit: ['A Direct Match']}\"]", "{'epiphysis': 'epiphysi'}"),
    ("enterica Salmonella", "enterica salmonella", "enterica salmonella", "['salmonella enterica:NCBITAXON_28901']", "Component Match", "[\"{salmonella enterica: ['A Direct Match']}\"]", "{}"),
    ("anatomical fruit seed part's", *SEED),
    # suffixes
    ("taco food product", "taco food product", "taco food product", "['food:CHEBI_33290']", "Component Match", "[\"{food: ['A Direct Match']}\"]", "{}"), ("swamp cabbage plant as food source", *SWAMP), ("swamp cabbage's plant as food source", *SWAMP),
    # no text, no match
    ("", "", "", *NONE), ("Svecia Baked", "svecia baked", "svecia baked", *NONE), ("Cornflakes Noodles", "cornflakes noodle", "cornflakes noodle", "[]", "No Match", "['Inflection (Plural) Treatment: noodles']", "{'noodles': 'noodle'}"),
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("resources")
    for name, entries in FILES.items():
        with open(path / name, "w", newline="") as f:
            csv.writer(f).writerows([("key", "value"), *entries])
    return path


def _run(spark, folder, tmp_path, kind, *flags):
    from taxoflow import cli

    source, out = tmp_path / f"in.{kind}", tmp_path / "out.tsv"
    with open(source, "w", newline="") as f:
        csv.writer(f, delimiter="," if kind == "csv" else "\t").writerows([("SampleId", "Sample"), *((i, r[0]) for i, r in enumerate(ROWS))])
    cli.main([str(source), "-r", str(folder), "-o", str(out), *flags])
    return [x.split("\t") for x in out.read_text().split("\n")[:-1]]


@pytest.mark.parametrize("kind", ["csv", "tsv"])
def test_full(spark, folder, tmp_path, kind):
    got = _run(spark, folder, tmp_path, kind, "-f")
    assert got[0] == ["Sample_Id", "Sample_Desc", "Processed_Sample", "Processed_Sample (With Scientific Name)", "Matched_Components", "Match_Status(Macro Level)", "Match_Status(Micro Level)", "Sample_Transformations"]
    assert [tuple(x[1:]) for x in got[1:]] == [(r[0].strip(), *r[1:]) for r in ROWS]


def test_not_full_and_cached(spark, folder, tmp_path):
    want = [[str(i), r[0].strip(), *r[1:5]] for i, r in enumerate(ROWS)]
    cache = tmp_path / "cache"
    for flags in ((), ("--cache", str(cache)), ("--cache", str(cache)), ("--cache", str(cache), "--no-cache")):
        assert _run(spark, folder, tmp_path, "csv", *flags)[1:] == want
    (made,) = cache.iterdir()
    assert (made / "match_table" / "_SUCCESS").exists()
    (folder / "terms.csv").write_text((folder / "terms.csv").read_text() + "x_1,yogurt\n")
    again = _run(spark, folder, tmp_path, "csv", "--cache", str(cache))
    assert again[4][4] == "['frozen:PATO_0001985', 'yogurt:X_1']"
    assert len(list(cache.iterdir())) == 2
