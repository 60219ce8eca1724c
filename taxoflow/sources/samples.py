"""Sample files and result files."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflow.functions import text as T

DELIMITERS = {".csv": ",", ".tsv": "\t"}
#: Columns of a record that arrives in a stream, whose schema is fixed; more raise.
WIDEST = 64
BASE = ("Sample_Id", "Sample_Desc", "Processed_Sample", "Processed_Sample (With Scientific Name)", "Matched_Components", "Match_Status(Macro Level)")
FULL = ("Match_Status(Micro Level)", "Sample_Transformations")
BUCKETS_FULL = ("Bucket Classification (Full List)", "Bucket", "Third Party Bucket", "Third Party Classification")


def input_path(path: str) -> str:
    """A path of samples: its ending names a delimiter, and if it is local it exists."""
    ending = Path(path).suffix.lower()
    if ending not in DELIMITERS:
        raise argparse.ArgumentTypeError(f"{path} ends in none of {', '.join(DELIMITERS)}")
    if "://" not in path and not any(c in path for c in "*?[") and not Path(path).exists():
        raise FileNotFoundError(path)
    return path


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(row_key, sample_id, sample_desc): the first column trimmed, the others joined by a blank and trimmed.

    The header is skipped and not looked at. Blank lines are skipped. ``row_key`` follows
    the order of the file, or of each of several. Records may be of any width, and quoted cells may hold line breaks,
    so one file is read by one task, twice.
    """
    input_path(path)
    sep = DELIMITERS[Path(path).suffix.lower()]
    # with one column in the schema every wider record counts as corrupt and is kept whole
    whole = spark.read.option("columnPruning", False).csv(path, schema=f"c0 string, {_WHOLE} string", columnNameOfCorruptRecord=_WHOLE, maxColumns=_MOST, **_record_options(sep))
    width = max(2, whole.agg(F.max(_most_cells(sep)), F.count("c0")).first()[0] or 0)
    raw = spark.read.option("columnPruning", False).csv(path, schema=", ".join(f"c{i} string" for i in range(width)), maxColumns=max(width, 512), **_record_options(sep))
    return without_headers(raw.withColumn("row_key", F.monotonically_increasing_id()), "row_key").select("row_key", *_id_and_text(width))


def without_headers(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` read from files without the first row of each file, by the column ``key`` that follows their order."""
    named = rows.withColumn("_file", F.input_file_name())
    heads = named.groupBy("_file").agg(F.min(key).alias(key)).select(key)
    return named.join(heads, key, "left_anti").drop("_file")


_WHOLE = "_whole"
_MOST = 1_000_000


def _record_options(sep: str) -> dict[str, object]:
    return {"sep": sep, "header": False, "quote": '"', "escape": '"', "enforceSchema": True, "mode": "PERMISSIVE", "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _most_cells(sep: str) -> Column:
    """A bound of a record's cells: its delimiters, quoted ones included, and one."""
    return F.coalesce(F.length(_WHOLE) - F.length(F.translate(_WHOLE, sep, "")), F.lit(0)) + 1


def _id_and_text(width: int) -> tuple[Column, Column]:
    return F.trim(F.coalesce("c0", F.lit(""))).alias("sample_id"), F.trim(F.concat_ws(" ", *(F.col(f"c{i}") for i in range(1, width)))).alias("sample_desc")


def stream_samples(spark: SparkSession, folder: str, delimiter: str = ",", *, width: int = WIDEST) -> DataFrame:
    """As ``read_samples`` for files that arrive in a folder; the header is told by its position in no file, so files have none.

    A record with ``width`` delimiters or more, quoted ones included, raises instead of losing cells.
    """
    schema = ", ".join([*(f"c{i} string" for i in range(width)), f"{_WHOLE} string"])
    raw = spark.readStream.option("columnPruning", False).csv(folder, schema=schema, columnNameOfCorruptRecord=_WHOLE, maxColumns=_MOST, **_record_options(delimiter))
    fits = F.when(_most_cells(delimiter) > width, F.raise_error(F.lit(f"a record may have more than {width} columns"))).otherwise(F.col("c0"))
    return raw.withColumn("c0", fits).select(*_id_and_text(width))


def output_columns(full: bool, bucket: bool) -> list[str]:
    """Header of a result file."""
    return [*BASE, *(FULL if full else ()), *((BUCKETS_FULL if full else BUCKETS_FULL[-1:]) if bucket else ())]


def render(matched: DataFrame, *, full: bool = False, bucket: bool = False) -> DataFrame:
    """One text column ``line`` for each row, lists and mappings as Python shows them, in the order of ``row_key``."""
    cells: list[Column] = [F.col(c) for c in ("sample_id", "sample_desc", "cleaned", "cleaned_sci")] + [T.py_list(F.col("matched")), F.col("macro")]
    if full:
        cells += [T.py_list(F.col("micro")), T.py_dict(F.col("conversions"))]
    if bucket:
        cells += ([F.col("full_list"), F.col("buckets"), F.col("third_buckets")] if full else []) + [T.py_list(F.col("classes"))]
    return matched.select("row_key", F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in cells)).alias("line"))


def write_tsv(matched: DataFrame, path: str | None, *, full: bool = False, bucket: bool = False) -> None:
    """One file in input order, or standard output if ``path`` is None. For large results use ``write_parts`` or ``write_table``."""
    lines = render(matched, full=full, bucket=bucket).orderBy("row_key").select("line")
    header = "\t".join(output_columns(full, bucket))
    if path is None:
        print("\n".join([header, *(r.line for r in lines.toLocalIterator())]))
        return
    with open(path, "w", encoding="utf-8") as f:
        f.write(header)
        for r in lines.toLocalIterator():
            f.write("\n" + r.line)
        f.write("\n")


def write_parts(matched: DataFrame, path: str, *, full: bool = False, bucket: bool = False) -> None:
    """Tab-separated text below ``path``, written by all executors: its files in the order of their names are the lines in input order, without header."""
    render(matched, full=full, bucket=bucket).orderBy("row_key").select("line").write.mode("overwrite").text(path)


def write_table(matched: DataFrame, path: str) -> None:
    """Typed columns as Parquet, written by all executors."""
    matched.write.mode("overwrite").parquet(path)


def write_specifications(specs: DataFrame, path: str, kind: str = "json") -> None:
    """Ontology entities as JSON lines, or as TSV with lists joined by bars and without tabs and line breaks."""
    if kind == "json":
        specs.write.mode("overwrite").json(path)
        return
    flat = [F.translate(F.concat_ws("|", c) if t.startswith("array") else F.col(c).cast("string"), "\t\n", "").alias(c) for c, t in specs.dtypes if not t.startswith(("map", "struct"))]
    specs.select(*flat).write.mode("overwrite").csv(path, sep="\t", header=True)


# Settings -------------------------------------------------------------------------


@dataclass
class Options:
    """Settings of a run."""

    input_file: str | None = None
    output: str | None = None
    full: bool = False
    bucket: bool = False
    config: str | None = None
    no_cache: bool = False
    cache: str | None = None
    profile: str | None = None


def with_profile(options: Options, profile: Mapping[str, object]) -> Options:
    """Options with unset ones taken from a profile; texts such as "True" count as flags."""
    out = Options(**vars(options))
    for name, value in profile.items():
        if hasattr(out, name) and not getattr(out, name):
            setattr(out, name, value in (True, "True", "true") if isinstance(getattr(Options, name, None), bool) else value)
    return out


def read_profile(path: str) -> dict[str, object]:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_config(path: str) -> list[tuple[int, str, str]]:
    """(priority, ontology, root) from a list of one-key objects; the first listed has the greatest priority, '' is the top class."""
    entries = json.loads(Path(path).read_text(encoding="utf-8"))
    out = []
    for i, e in enumerate(entries):
        if len(e) != 1:
            raise ValueError(f"entry {i} of {path} has {len(e)} keys")
        (iri, root), = e.items()
        out.append((len(entries) - i, iri, root or "http://www.w3.org/2002/07/owl#Thing"))
    return out


def cache_key(*paths: str) -> str:
    """Name for what is made of some files: by their content, so that a changed file is never stale. Missing files count as empty."""
    import hashlib

    h = hashlib.sha256()
    for p in paths:
        content = Path(p).read_bytes() if os.path.exists(p) else b""
        h.update(f"{os.path.basename(p)} {len(content)}\n".encode() + content)
    return h.hexdigest()[:16]


#: A component with its term id within a cell, such as ``{'label': 'id'}`` or ``['label:id', ...]``.
_COMPONENT = r"""['"]([^'"]+)['"](?:\s*:\s*['"]([^'"]+)['"])?"""


def read_result_log(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, sample_desc, matched_components, buckets, classes) of a tab-separated log of results.

    A line is ``id, text, ..., components, ..., buckets, classes``. ``components`` is the first
    cell that opens with a bracket or brace and holds quoted labels, each with or without an
    id; they come as ``label:id`` or ``label``. ``buckets`` and ``classes`` are lists split at
    commas; a bucket may carry its level as ``3: label``, which is left out. All three come in
    lower case as arrays. The first line is the header; lines of fewer than four cells are
    left out. Of several lines for one id the last holds.
    """
    cells = F.split("value", "\t")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("row_key", "value"))
    rows = lines.where("row_key > 0").select("row_key", cells.alias("c")).where(F.size("c") >= 4)
    listed = lambda c: F.filter(F.transform(F.split(F.lower(c), ","), lambda x: F.trim(F.regexp_replace(x, r"^[\s\[{]*\d*\s*:|[\[\]{}'\"]", ""))), lambda x: x != "")
    cell = F.lower(F.get(F.filter("c", lambda x: x.rlike(r"^\s*[\[{]")), F.lit(0)))
    both = F.arrays_zip(F.regexp_extract_all(cell, F.lit(_COMPONENT), F.lit(1)).alias("label"), F.regexp_extract_all(cell, F.lit(_COMPONENT), F.lit(2)).alias("id"))
    parts = F.transform(both, lambda x: F.when(x["id"] == "", x["label"]).otherwise(F.concat(x["label"], F.lit(":"), x["id"])))
    out = rows.select("row_key", F.get("c", F.lit(0)).alias("sample_id"), F.get("c", F.lit(1)).alias("sample_desc"), F.coalesce(parts, F.array().cast("array<string>")).alias("matched_components"), listed(F.element_at("c", -2)).alias("buckets"), listed(F.element_at("c", -1)).alias("classes"))
    last = out.groupBy("sample_id").agg(F.max_by(F.struct("sample_desc", "matched_components", "buckets", "classes"), "row_key").alias("v"))
    return last.select("sample_id", "v.*")
