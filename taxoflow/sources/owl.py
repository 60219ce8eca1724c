"""Ontologies in RDF/XML as tables of classes, and the dimensions made of them."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflow.functions import text as T
from taxoflow.operators import hierarchy_links as H
from taxoflow.session import durable

THING = "http://www.w3.org/2002/07/owl#Thing"
_TEXT = "array<struct<_VALUE: string, `_xml:lang`: string>>"
_REF = "array<struct<`_rdf:resource`: string>>"
SYNONYM_FIELDS = ("oboInOwl:hasSynonym", "oboInOwl:hasNarrowSynonym", "oboInOwl:hasExactSynonym", "oboInOwl:hasBroadSynonym", "obo:IAO_0000118")
#: Synonyms that count for matching, in the order in which they are loaded.
MATCHED_SYNONYMS = SYNONYM_FIELDS[:3]
_MEMBER = "array<struct<`owl:Class`: struct<`owl:unionOf`: struct<`rdf:Description`: array<struct<`_rdf:about`: string>>>>>>"
_SCHEMA = ", ".join(
    [
        "`_rdf:about` string", f"`rdfs:label` {_TEXT}", f"`rdfs:subClassOf` {_REF}", f"`obo:IAO_0000115` {_TEXT}", f"`obo:IAO_0100001` {_REF}", f"`owl:deprecated` {_TEXT}",
        f"`owl:equivalentClass` {_MEMBER}", *(f"`{s}` {_TEXT}" for s in SYNONYM_FIELDS),
    ]
)


def resolve(path: str) -> tuple[str, str]:
    """Path of an ontology file and the base name of what is made of it; only local and cluster paths."""
    if path.startswith(("http://", "https://")):
        raise ValueError("ontologies are read from files; fetch the URL first")
    return path, os.path.splitext(os.path.basename(path))[0]


def _best(texts: str) -> Column:
    """Of several texts the one with the greatest language, then text."""
    return F.array_max(F.transform(texts, lambda x: F.struct(F.coalesce(x["_xml:lang"], F.lit("")).alias("lang"), x["_VALUE"].alias("value"))))["value"]


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(uri, label, definition, parents, deprecated, replaced_by, members, synonym arrays by field) of each named class.

    Anonymous classes and restrictions are left out. ``members`` are those of a union.
    """
    raw = spark.read.format("xml").option("rowTag", "owl:Class").schema(_SCHEMA).load(path).where("`_rdf:about` is not null")
    refs = lambda c: F.filter(F.transform(c, lambda x: x["_rdf:resource"]), lambda x: x.isNotNull())
    union = F.flatten(F.transform(F.coalesce(F.col("`owl:equivalentClass`"), F.array().cast(_MEMBER)), lambda e: F.coalesce(e["owl:Class"]["owl:unionOf"]["rdf:Description"], F.array().cast("array<struct<`_rdf:about`: string>>"))))
    none = F.array().cast("array<string>")
    return raw.select(
        F.col("`_rdf:about`").alias("uri"), _best("`rdfs:label`").alias("label"), _best("`obo:IAO_0000115`").alias("definition"),
        F.coalesce(refs("`rdfs:subClassOf`"), none).alias("parents"), _best("`owl:deprecated`").alias("deprecated"), F.get(refs("`obo:IAO_0100001`"), F.lit(0)).alias("replaced_by"),
        F.transform(union, lambda x: x["_rdf:about"]).alias("members"),
        *(F.coalesce(F.flatten(F.transform(f"`{s}`", lambda x: T.clean_synonyms(x["_VALUE"]))), none).alias(s) for s in SYNONYM_FIELDS),
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(uri, title, version, imports) of the file's ontology header."""
    schema = f"`_rdf:about` string, `dc:title` {_TEXT}, `terms:title` {_TEXT}, `owl:versionIRI` {_REF}, `owl:imports` {_REF}"
    raw = spark.read.format("xml").option("rowTag", "owl:Ontology").schema(schema).load(path)
    refs = lambda c: F.coalesce(F.transform(c, lambda x: x["_rdf:resource"]), F.array().cast("array<string>"))
    title = F.coalesce(_best("`dc:title`"), _best("`terms:title`"))
    return raw.select(F.col("`_rdf:about`").alias("uri"), title.alias("title"), F.get(refs("`owl:versionIRI`"), F.lit(0)).alias("version"), F.array_sort(refs("`owl:imports`")).alias("imports"))


def read_with_imports(spark: SparkSession, path: str) -> DataFrame:
    """Classes of a file and of those of its imports that lie in the folder ``imports`` beside it; others only warn."""
    out = read_classes(spark, path)
    for row in read_metadata(spark, path).collect():  # one header
        for uri in row.imports:
            local = os.path.join(os.path.dirname(path), "imports", os.path.basename(uri))
            if os.path.exists(local):
                out = out.unionByName(read_classes(spark, local))
            else:
                warnings.warn(f"import {uri} is not at {local}", stacklevel=2)
    return out


def class_links(classes: DataFrame) -> DataFrame:
    """(node, parent) by URI."""
    return classes.select(F.col("uri").alias("node"), F.explode_outer("parents").alias("parent")).distinct()


def subclass_tree(classes: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """(uri, label, definition, parent, other_parents, ...) of the roots and all that lies below them.

    A root, or a parent that has no class of its own, comes with nulls in all fields but the
    URI. A class without a parent lies below the top class. Parents that lie outside the tree
    are left out; the others keep the order of the file. Classes in loops belong to the tree as all others do; a class is
    never given as its own parent.
    """
    roots = roots or [THING]
    links = class_links(classes).withColumn("parent", F.when(F.col("node") == THING, F.lit(None)).otherwise(F.coalesce("parent", F.lit(THING))))
    up = H.reachable(links)
    inside = up.where(F.col("ancestor").isin(roots)).select(F.col("node").alias("uri")).distinct()
    start = classes.sparkSession.createDataFrame([(r,) for r in roots], "uri string")
    inside = inside.unionByName(start).distinct()
    near = links.join(inside.select(F.col("uri").alias("parent")), "parent", "left_semi").join(inside.select(F.col("uri").alias("node")), "node", "left_semi")
    placed = classes.select(F.col("uri").alias("node"), F.posexplode("parents").alias("pos", "parent")).groupBy("node", "parent").agg(F.min("pos").alias("pos"))
    near = near.where(~F.col("node").isin(roots) & (F.col("node") != F.col("parent"))).join(placed, ["node", "parent"], "left")
    parents = near.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "parent"))), lambda x: x["parent"]).alias("p"))  # as the file has them
    j = inside.join(classes.drop("parents"), "uri", "left").join(parents, F.col("uri") == F.col("node"), "left")
    return j.withColumn("id", T.compact_uri("uri")).withColumn("parent_id", T.compact_uri(F.get("p", F.lit(0)))).withColumn("other_parents", F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), T.compact_uri)).drop("p", "node")


def dimensions(trees: list[tuple[int, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, synonyms, parents) of several trees; a tree of greater priority holds where labels or synonyms clash.

    ``terms`` (term_id, label, pos) and ``synonyms`` (syn, std) are as ``labels_of`` and
    ``match_table`` take them; ``parents`` (node, parent) joins those of all trees. A class that
    is its own first parent brings no parents.
    """
    terms = synonyms = parents = None
    for priority, tree in trees:
        named = tree.where("label is not null and id is not null")
        t = named.select(T.lookup_id("id").alias("term_id"), F.lower("label").alias("label"), F.struct(F.lit(priority).alias("p"), F.col("id").alias("i")).alias("pos"))
        syn = F.concat(*(F.transform(f"`{s}`", lambda x: F.lower(x)) for s in MATCHED_SYNONYMS))
        std = T.punctuation_treatment(F.lower("label"))
        s = named.select(F.explode(syn).alias("syn"), std.alias("std"), F.lit(priority).alias("p")).select(T.punctuation_treatment("syn").alias("syn"), "std", "p").where("syn <> ''")
        own = T.lookup_id("id")
        first = T.lookup_id("parent_id")
        p = named.where((own != first)).select(own.alias("node"), F.explode(F.concat(F.array(first), F.transform(F.coalesce("other_parents", F.array().cast("array<string>")), T.lookup_id))).alias("parent")).where("node <> parent")
        terms, synonyms, parents = (a if b is None else b.unionByName(a) for a, b in ((t, terms), (s, synonyms), (p, parents)))
    return terms, synonyms.groupBy("syn").agg(F.max_by("std", F.struct("p", "std")).alias("std")), parents.distinct()


def ancestor_arrays(parents: DataFrame) -> DataFrame:
    """(node, ancestors) for ``drop_ancestors``; the ancestors of one node are few.

    Of a loop no class goes because of another one in it, or all of them would.
    """
    links = parents.select("node", "parent")
    loops = durable(H.loop_nodes(links))
    label = lambda c: loops.select(F.col("node").alias(c), F.col("label").alias(f"{c}_loop"))
    up = H.reachable(links).join(label("node"), "node", "left").join(label("ancestor"), "ancestor", "left").where("node_loop is null or ancestor_loop is null or node_loop <> ancestor_loop")
    return up.groupBy("node").agg(F.collect_list("ancestor").alias("ancestors"))
