"""Records that differ only in formatting or in the order of their fields.

Progressive refinement: a first scan classes all records by cheap invariants, which
neither formatting nor field order changes: the stripped length in letters and in bytes,
the number of digits and a histogram of letters. It shuffles partial counts only.
Records that are alone in their class are done. Only members of the other classes get
the costly key: every field stripped to letters and digits, the fields sorted, and the
whole digested to 16 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxoflow.llm.hot import hot_keys, salted_join
from taxoflow.session import durable

# Frequent letters of several scripts and digits; the histogram counts each of them.
HISTOGRAM = "EAIRTONSОАИΑΟ012"


def one_case(c: Column) -> Column:
    """Upper case by way of lower case, so that a letter has one form wherever it stands in a word.

    Without the step between, Catalyst would leave out the lower case.
    """
    return F.upper(F.replace(F.lower(c), F.lit("\x00"), F.lit("")))


def plain(c: Column | str) -> Column:
    """Letters and digits in one case; null for none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(one_case(c.cast("string")), r"[^\p{L}\p{N}]+", F.lit("")), F.lit(""))


def _prepared(records: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, list[str]]:
    """Id, the fields as text under names of their own, and the class; records without letters or digits left out."""
    names = [f"_f{i}" for i in range(len(fields))]
    rows = records.select(F.col(key).alias("_id"), *(F.col(c).cast("string").alias(n) for c, n in zip(fields, names, strict=True)))
    rows = rows.withColumn("_plain", plain(F.concat_ws(" ", *names))).where("_plain is not null")
    counts = [F.length("_plain") - F.length(F.replace("_plain", F.lit(x), F.lit(""))) for x in HISTOGRAM]
    return rows.select("_id", *names, F.xxhash64(F.length("_plain"), F.octet_length("_plain"), *counts).alias("_class")), names


def _key(names: list[str]) -> Column:
    return F.unhex(F.md5(F.array_join(F.array_sort(F.array_compact(F.array(*(plain(n) for n in names)))), "\x01")))


def copy_members(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, kept, n): each record that has copies, with the smallest id and the size of its group.

    Records are copies if their ``fields`` hold the same letters and digits in the same
    order, case disregarded, in any order of the fields. A field that is null or has no
    letter or digit counts as absent; a record without any is left out. A key that
    stands twice is two members. Other columns are not read. An empty table gives none.
    """
    rows, names = _prepared(records, key, fields)
    several = durable(rows.groupBy("_class").agg(F.count("*").alias("n")).where("n > 1"))
    members = durable(salted_join(rows, several.select("_class"), "_class", hot_keys(several, "_class"), "_id").select("_id", _key(names).alias("_key")))
    groups = durable(members.groupBy("_key").agg(F.min("_id").alias("kept"), F.count("*").alias("n")).where("n > 1"))
    return salted_join(members, groups, "_key", hot_keys(groups, "_key"), "_id").select(F.col("_id").alias("id"), "kept", "n")


def collapse(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(kept, n_copies): each distinct record once, by its smallest id, with its number of copies.

    Single records come with 1; records without letters or digits are left out.
    """
    rows, names = _prepared(records, key, fields)
    classes = durable(rows.groupBy("_class").agg(F.min("_id").alias("kept"), F.count("*").alias("n")))
    alone = classes.where("n = 1").select("kept", F.col("n").alias("n_copies"))
    several = classes.where("n > 1")
    members = salted_join(rows, several.select("_class"), "_class", hot_keys(several, "_class"), "_id")
    groups = members.groupBy(_key(names).alias("_key")).agg(F.min("_id").alias("kept"), F.count("*").alias("n_copies"))
    return alone.unionByName(groups.select("kept", "n_copies"))
