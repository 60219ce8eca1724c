"""python -m taxoflow.cli INPUT --resources FOLDER, or python -m taxoflow.cli ontology FILE --output FOLDER"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from taxoflow import __version__
from taxoflow.plans import pipeline
from taxoflow.sources import samples as S


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="taxoflow", description="Map sample descriptions to ontology terms")
    p.add_argument("input_file", type=S.input_path, help="csv or tsv file of samples")
    p.add_argument("-r", "--resources", required=True, help="folder of lexicon files")
    p.add_argument("-o", "--output", help="result file; standard output by default")
    p.add_argument("-f", "--full", action="store_true", help="also treatments and transformations")
    p.add_argument("-b", "--bucket", action="store_true", help="also classify, by the bucket files of the resource folder")
    p.add_argument("-c", "--config", help="JSON list of ontologies and roots")
    p.add_argument("-p", "--profile", help="JSON file of default arguments")
    p.add_argument("--cache", help="folder in which tables made of the resources are kept, by their content")
    p.add_argument("--no-cache", action="store_true", help="make these tables anew")
    p.add_argument("-v", "--version", action="version", version=f"%(prog)s {__version__}")
    return p


def ontology_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="taxoflow ontology", description="Write the classes of an ontology file as a table")
    p.add_argument("file", help="RDF/XML file; imports are looked for in the folder imports beside it")
    p.add_argument("-r", "--root", action="append", help="class at the top, the top class by default; may be repeated")
    p.add_argument("-o", "--output", required=True, help="folder of the result")
    p.add_argument("-t", "--tsv", action="store_true", help="tab-separated values instead of JSON lines")
    return p


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    session = SparkSession.builder.appName("taxoflow")
    if argv[:1] == ["ontology"]:
        a = ontology_parser().parse_args(argv[1:])
        pipeline.describe(session.getOrCreate(), a.file, a.root, a.output, "tsv" if a.tsv else "json")
        return
    a = parser().parse_args(argv)
    options = S.Options(a.input_file, a.output, a.full, a.bucket, a.config, a.no_cache, a.cache)
    if a.profile:
        options = S.with_profile(options, S.read_profile(a.profile))
    pipeline.run(session.getOrCreate(), options, a.resources)


if __name__ == "__main__":
    main()
