"""Reading delimited lines whose rows may be broken.

The lines are parsed in Arrow batches by the CSV reader of pyarrow. Its invalid-row
callback reports structural rejects; all fields are read as strings, then whole
columns are tested and the failing cell is named. Each line is parsed alone, for no
field spans lines, so neither a file nor a hot file has to be in one task.
"""

from __future__ import annotations

import csv as _csv
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reasons in the order in which they apply.
QUOTING, COLUMNS, VALUE, FILE = "quoting", "columns", "value", "file"
_UNPRINTABLE = r"[\x00-\x08\x0a-\x1f\x7f\x{FFFD}]"
#: Bytes of text parsed in one call of the CSV reader.
_PARSE_BYTES = 32 << 20


def _header(line: str | None, delim: str) -> list[str]:
    return next(_csv.reader([line or ""], delimiter=delim), [""])


def _parse(lines: pa.Array, delim: str, n: int) -> tuple[pa.Array, list[pa.Array]]:
    """Mask of lines with ``n`` fields, and the fields of these as string arrays."""
    wrong: list[int] = []

    def reject(row: pcsv.InvalidRow) -> str:
        wrong.append(row.number - 2)  # counted from 1, after the guard line
        return "skip"

    guard = pa.array([delim.join(["0"] * n)])  # keeps a byte order mark in the first line
    whole = pa.ListArray.from_arrays(pa.array([0, len(lines) + 1], pa.int32()), pa.concat_arrays([guard, lines]))
    text = pc.binary_join(whole, "\n")[0].as_buffer()
    names = [str(i) for i in range(n)]
    parsed = pcsv.read_csv(
        pa.BufferReader(text),
        read_options=pcsv.ReadOptions(column_names=names, use_threads=False, block_size=len(text) + 2),
        parse_options=pcsv.ParseOptions(delimiter=delim, ignore_empty_lines=False, newlines_in_values=False, invalid_row_handler=reject),
        convert_options=pcsv.ConvertOptions(column_types={c: pa.string() for c in names}, strings_can_be_null=False),
    ).slice(1)
    bad = set(wrong)
    if parsed.num_rows + len(bad) != len(lines):
        raise ValueError(f"{len(lines)} lines gave {parsed.num_rows} rows and {len(bad)} rejects")
    return pa.array([i not in bad for i in range(len(lines))]), [parsed.column(i).combine_chunks() for i in range(n)]


def _chunks(lines: pa.Array) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(lines).to_pylist()):
        if i > start and size + n > _PARSE_BYTES:
            yield start, i
            start, size = i, 0
        size += n + 1
    if len(lines):
        yield start, len(lines)


def _load(keys: pa.Array, raw: pa.Array, delim: str, header: str, prefix: str) -> Iterator[pa.RecordBatch]:
    names = _header(header, delim)
    n = len(names)
    id_at = next((i for i, x in enumerate(names) if x.strip().lower() == "sampleid"), 0)
    d = re.escape(delim) if delim != "\t" else r"\t"
    cell = rf'(?:"(?:[^"]|"")*"|[^"{d}]*)'
    clean = pc.replace_substring_regex(pc.fill_null(raw, ""), r"[\r\n]", "\x01")
    for a, b in _chunks(clean):
        lines, key = clean.slice(a, b - a), keys.slice(a, b - a)
        quoted_well = pc.match_substring_regex(lines, rf"(?s)^{cell}(?:{d}{cell})*$")
        yield _rows(key.filter(pc.invert(quoted_well)), QUOTING)
        lines, key = lines.filter(quoted_well), key.filter(quoted_well)
        blank = pc.equal(lines, "")  # the CSV reader would make a row of empty fields
        yield _rows(key.filter(blank), COLUMNS)
        lines, key = lines.filter(pc.invert(blank)), key.filter(pc.invert(blank))
        if not len(lines):
            continue
        shaped, fields = _parse(lines, delim, n)
        yield _rows(key.filter(pc.invert(shaped)), COLUMNS)
        lines, key = lines.filter(shaped), key.filter(shaped)
        sid = pc.utf8_trim_whitespace(fields[id_at])
        if n > 1:
            text = pc.utf8_trim_whitespace(pc.binary_join_element_wise(*(f for i, f in enumerate(fields) if i != id_at), " "))
        else:
            text = pa.array([""] * len(lines), pa.string())
        digits = pc.utf8_slice_codeunits(sid, len(prefix))
        good_id = pc.and_(pc.starts_with(sid, prefix), pc.match_substring_regex(digits, "^[0-9]+$"))
        good_text = pc.match_substring_regex(text, r"\p{L}")
        printable = pc.invert(pc.match_substring_regex(lines, _UNPRINTABLE))
        good = pc.and_(pc.and_(good_id, good_text), printable)
        cause = pc.if_else(printable, pc.if_else(good_id, pc.if_else(good_text, None, "Sample"), "SampleId"), "character")
        bad = pc.invert(good)
        yield _rows(key.filter(bad), VALUE, cause.filter(bad))
        yield _rows(key.filter(good), None, None, sid.filter(good), text.filter(good))


def _rows(key: pa.Array, reason: str | None, cell: pa.Array | None = None, sid: pa.Array | None = None, text: pa.Array | None = None) -> pa.RecordBatch:
    def or_null(x: pa.Array | None) -> pa.Array:
        return pa.nulls(len(key), pa.string()) if x is None else x.cast(pa.string())

    why = pa.array([reason] * len(key), pa.string())
    return pa.RecordBatch.from_arrays([key, why, or_null(cell), or_null(sid), or_null(text)], names=["line_key", "reason", "failing_cell", "sample_id", "sample"])


def _load_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = pc.binary_join_element_wise(*(pc.fill_null(batch.column(i), "") for i in (2, 3, 4)), "\x00").dictionary_encode()
        order = pc.sort_indices(kind.indices)
        codes = kind.indices.take(order).to_numpy()
        keys, raw = batch.column(0).take(order), batch.column(1).take(order)
        edges = [0, *((codes[1:] != codes[:-1]).nonzero()[0] + 1).tolist(), len(codes)]
        for a, b in zip(edges, edges[1:], strict=False):
            delim, header, prefix = kind.dictionary[int(codes[a])].as_py().split("\x00", 2)
            if len(delim) != 1:
                yield _rows(keys.slice(a, b - a), FILE)
                continue
            yield from _load(keys.slice(a, b - a), raw.slice(a, b - a), delim, header, prefix)


def load_lines(
    lines: DataFrame,
    files: DataFrame,
    *,
    key: str = "line_id",
    file: str = "file_id",
    text: str = "raw_line",
    delim: str = "delim",
    header: str = "header_line",
    prefix: str = "id_prefix",
) -> DataFrame:
    """Read each line of ``lines`` by the delimiter, header and id prefix of its file.

    Returns one row for each line: ``key``, ``reason`` (null for a line that loads),
    ``failing_cell`` (for the reason ``value``: SampleId, Sample or character),
    ``sample_id`` (trimmed) and ``sample`` (all other fields joined by one blank, trimmed).

    * ``quoting``: a double quote stands anywhere but around a whole field or doubled
      inside such a field. ``columns``: the number of fields differs from the header's;
      a null, empty or blank line is one empty field. ``value``: see ``failing_cell``.
      The first that applies is given. ``file``: the file is unknown or has no
      delimiter of one character.
    * A repeated line or key is read as often as it stands there. Empty tables give no
      rows. Only the named columns are read, so other columns may have any name.
    * A file row that is given twice for one id would double its lines; ids of
      ``files`` are taken to be unique. A null id or prefix counts as unknown or ''.
    """
    l = lines.select(F.col(key).alias("_key"), F.col(file).alias("_file"), F.col(text).cast("string").alias("_raw"))
    f = files.select(F.col(file).alias("_file"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{i}") for i, c in enumerate((delim, header, prefix))))
    joined = l.join(f, "_file", "left").select("_key", "_raw", "_0", "_1", "_2")
    kind = lines.schema[key].dataType.simpleString()
    out = joined.mapInArrow(_load_batches, f"line_key {kind}, reason string, failing_cell string, sample_id string, sample string")
    return out.withColumnRenamed("line_key", key)


def rejected(loaded: DataFrame) -> DataFrame:
    """Lines of ``load_lines`` that failed."""
    return loaded.where(F.col("reason").isNotNull())


def accepted(loaded: DataFrame) -> DataFrame:
    """Lines of ``load_lines`` that loaded."""
    return loaded.where(F.col("reason").isNull())
