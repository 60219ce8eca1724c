"""Whole runs: resources, samples, matching and result."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflow.functions import text as T
from taxoflow.operators import classify, cleaning, lexicon, matching
from taxoflow.operators import hierarchy_links as H
from taxoflow.session import bounded_rows
from taxoflow.sources import owl
from taxoflow.sources import samples as S

#: Files of a resource folder; those that are missing count as empty.
FILES = {"abbreviations": "abbreviations.csv", "non_english": "non_english.csv", "spelling": "spelling.csv", "exceptions": "inflection_exceptions.csv", "stop_words": "stop_words.csv", "scientific": "scientific_names.csv"}


@dataclass
class Resources:
    """What samples are matched against."""

    lexicon: lexicon.Lexicon
    table: DataFrame
    ancestors: DataFrame | None = None
    scheme: classify.Scheme | None = None


#: Classification files of a resource folder: buckets have label and id, phrases phrase and label, labels id and label.
BUCKET_FILES = ("buckets.csv", "third_buckets.csv", "third_labels.csv", "default_classes.csv", "refining_classes.csv", "priority_classes.csv")


def materialized(spark: SparkSession, make: Callable[[], DataFrame], path: str, *, renew: bool = False) -> DataFrame:
    """A table that is made once and read from ``path`` afterwards; ``samples.cache_key`` names the path by content.

    It is whole once its success mark is written, so a run that breaks off leaves nothing to read.
    """
    done = f"{path}/_SUCCESS"
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(done)
    found = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    if renew or not found:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Rows of a resource list whose order counts; such a list goes into the plan as literals.
ORDERED_ROWS = 20_000


def _in_order(rows: DataFrame, name: str) -> list[str]:
    """All keys by position; a list too long for a plan raises."""
    found = bounded_rows(rows.select("pos", "key"), ORDERED_ROWS)
    if found is None:
        raise ValueError(f"{name} has more than {ORDERED_ROWS} rows")
    return [r.key for r in sorted(found, key=lambda r: r.pos)]


def _scheme(spark: SparkSession, folder: str, terms: DataFrame, parents: DataFrame | None, keep: Callable[[str, DataFrame], DataFrame]) -> classify.Scheme | None:
    if not any(os.path.exists(os.path.join(folder, f)) for f in BUCKET_FILES):
        return None
    empty = spark.createDataFrame([], "kind string, key string, val string, pos long")
    own, third, labels, defaults, refining, priority = (lexicon.lexicon_rows(spark, os.path.join(folder, f), f) if os.path.exists(os.path.join(folder, f)) else empty for f in BUCKET_FILES)
    links = terms.select(T.lookup_id("term_id").alias("node"), F.lit(None).cast("string").alias("parent"))
    links = links if parents is None else links.unionByName(parents)
    bucket = lambda x: x.select(T.lookup_id("val").alias("term_id"), F.col("key").alias("label"), "pos")
    phrase = lambda x: lexicon.last_wins(x).select(F.col("key").alias("phrase"), F.col("val").alias("label"), "pos")
    by_id = lexicon.last_wins(labels).select(T.lookup_id("key").alias("bucket_id"), F.col("val").alias("label"))
    first = _in_order(priority, "priority_classes.csv")
    return classify.Scheme(keep("paths", H.node_paths(links.distinct())), bucket(own), bucket(third), by_id, phrase(defaults), phrase(refining), (), first)


def load_resources(spark: SparkSession, folder: str, config: str | None = None, ontologies: dict[str, str] | None = None, *, cache: str | None = None, no_cache: bool = False) -> Resources:
    """Resources of a folder of CSV files, and of the ontologies of a config.

    ``ontologies`` gives the local file of each address that the config names. With ``cache``,
    a folder that all executors share, what is costly to make (the match table, ancestors, the
    paths of the classification) is written there once for the content of all these files and
    read again; ``no_cache`` makes it anew. A folder of what one run cached serves as a
    profile's tables: give it as ``cache`` with the same files.
    """
    named = [p for _, iri, _ in S.read_config(config) for p in [(ontologies or {}).get(iri, iri)]] if config else []
    everything = [os.path.join(folder, f) for f in (*FILES.values(), *BUCKET_FILES, "terms.csv", "synonyms.csv", "suffixes.csv")]
    at = f"{cache}/{S.cache_key(*everything, *([config] if config else []), *named)}" if cache else None
    keep = lambda name, df: df if at is None or df is None else materialized(spark, lambda: df, f"{at}/{name}", renew=no_cache)
    rows = None
    for kind, name in FILES.items():
        path = os.path.join(folder, name)
        if os.path.exists(path):
            part = lexicon.lexicon_rows(spark, path, kind)
            rows = part if rows is None else rows.unionByName(part)
    lex = lexicon.Lexicon.from_rows(rows, {k: k for k in FILES}) if rows is not None else lexicon.Lexicon()
    read = lambda name: lexicon.lexicon_rows(spark, os.path.join(folder, name), name) if os.path.exists(os.path.join(folder, name)) else None
    found, syns, suffix_rows = read("terms.csv"), read("synonyms.csv"), read("suffixes.csv")
    terms = spark.createDataFrame([], "term_id string, label string, pos struct<p:int,i:string>") if found is None else found.select(F.col("key").alias("term_id"), F.col("val").alias("label"), F.struct(F.lit(0).alias("p"), F.lpad(F.col("pos").cast("string"), 20, "0").alias("i")).alias("pos"))
    synonyms = spark.createDataFrame([], "syn string, std string") if syns is None else lexicon.last_wins(syns.select(T.punctuation_treatment("key").alias("key"), T.punctuation_treatment("val").alias("val"), "pos")).select(F.col("key").alias("syn"), F.col("val").alias("std"))
    suffixes = lexicon.SUFFIXES if suffix_rows is None else tuple(_in_order(suffix_rows, "suffixes.csv"))
    ancestors = parents = None
    if config:
        trees = [(p, owl.subclass_tree(owl.read_with_imports(spark, (ontologies or {}).get(iri, iri)), root.split(","))) for p, iri, root in S.read_config(config)]
        more, more_syn, parents = owl.dimensions(trees)
        terms = terms.unionByName(more)
        synonyms = more_syn.unionByName(synonyms.join(more_syn.select("syn"), "syn", "left_anti"))
        ancestors = owl.ancestor_arrays(parents)
    scheme = _scheme(spark, folder, terms, parents, keep)
    return Resources(lex, keep("match_table", lexicon.match_table(lexicon.labels_of(terms), synonyms, suffixes)), keep("ancestors", ancestors), scheme)


def map_samples(samples: DataFrame, resources: Resources, *, bucket: bool = False) -> DataFrame:
    """Cleaned and matched samples, with ``bucket`` also classified; ``samples`` has row_key, sample_id and sample_desc."""
    out = matching.match_samples(cleaning.clean_samples(samples, resources.lexicon), resources.table, resources.ancestors)
    if bucket:
        if resources.scheme is None:
            raise ValueError(f"classification needs some of {', '.join(BUCKET_FILES)}")
        out = classify.classify_rows(out, resources.scheme)
    classes = F.col("classes") if bucket else F.array().cast("array<string>")
    return out.withColumn("cleaned_sci", cleaning.refine_scientific(F.col("sample"), F.col("cleaned"), F.col("cleaned_sci"), classes))


def run(spark: SparkSession, options: S.Options, folder: str, ontologies: dict[str, str] | None = None) -> None:
    """Match the samples of ``options.input_file`` and write the result file."""
    resources = load_resources(spark, folder, options.config, ontologies, cache=options.cache, no_cache=options.no_cache)
    matched = map_samples(S.read_samples(spark, options.input_file), resources, bucket=options.bucket)
    write = S.write_parts if options.output and options.output.endswith("/") else S.write_tsv
    write(matched, options.output, full=options.full, bucket=options.bucket)


def describe(spark: SparkSession, path: str, roots: list[str] | None, output: str, kind: str = "json") -> None:
    """Write the tree of an ontology file below ``roots``, its unions and its header: the folders ``specifications`` and ``ontology`` below ``output``."""
    path, _ = owl.resolve(path)
    tree = owl.subclass_tree(owl.read_with_imports(spark, path), roots)
    S.write_specifications(tree.orderBy("parent_id", "label", "id") if kind == "json" else tree.select("id", "label", "parent_id", "other_parents", "definition", "deprecated", "replaced_by", "members", F.concat(*(F.col(f"`{s}`") for s in owl.SYNONYM_FIELDS)).alias("synonyms")).orderBy("parent_id", "label", "id"), f"{output}/specifications", kind)
    S.write_specifications(owl.read_metadata(spark, path), f"{output}/ontology", kind)
