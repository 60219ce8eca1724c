"""Key-value resources and the dimensions that terms are looked up in."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflow.functions import text as T
from taxoflow.session import bounded_rows

# Words that complete a term, in the order in which they are tried.
SUFFIXES = (
    "food source", "vegetable food product", "nut food product", "seafood product", "meat food product", "plant fruit food product", "plant food product", "food product",
    "plant food source", "product", "whole", "deprecated", "animal feed", "bird", "liquid",
)
#: Labels of this many tokens and more are matched only in their own order.
PERMUTED_TOKENS = 7


def last_wins(rows: DataFrame, key: str = "key", value: str = "val", pos: str = "pos") -> DataFrame:
    """(key, val, pos): of each key the last value, at the key's first position."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.max_by(value, pos).alias("val"), F.min(pos).alias("pos"))


def merge_lookups(first: DataFrame, second: DataFrame) -> DataFrame:
    """(kind, key, val): all keys of both; where both have one, the second's value holds."""
    both = first.select("kind", "key", "val", F.lit(0).alias("p")).unionByName(second.select("kind", "key", "val", F.lit(1).alias("p")))
    return both.groupBy("kind", "key").agg(F.max_by("val", "p").alias("val"))


def check_mergeable(first: Mapping[str, object], second: Mapping[str, object]) -> None:
    """Raise ValueError unless both have the same kinds and only mappings as values."""
    if set(first) != set(second):
        raise ValueError("the lookups have different kinds")
    if not all(isinstance(v, Mapping) for d in (first, second) for v in d.values()):
        raise ValueError("a lookup's values must be mappings")


def merge_mappings(first: dict[str, dict], second: Mapping[str, Mapping]) -> dict[str, dict]:
    """As ``merge_lookups`` for small driver-side dictionaries; changes and returns ``first``."""
    check_mergeable(first, second)
    for kind, entries in second.items():
        first[kind].update(entries)
    return first


@dataclass
class Lexicon:
    """Bounded dictionaries of the cleaning stage, lower case."""

    abbreviations: Mapping[str, str] = field(default_factory=dict)
    non_english: Mapping[str, str] = field(default_factory=dict)
    spelling: Mapping[str, str] = field(default_factory=dict)
    exceptions: Mapping[str, str] = field(default_factory=dict)
    stop_words: Mapping[str, str] = field(default_factory=dict)
    scientific: Mapping[str, str] = field(default_factory=dict)

    @staticmethod
    def from_rows(rows: DataFrame, kinds: Mapping[str, str]) -> Lexicon:
        """From (kind, key, val, pos) rows; ``kinds`` names the kind of each field."""
        wanted = rows.where(F.col("kind").isin(*kinds.values()))
        clean = wanted.select("kind", F.lower(F.trim("key")).alias("key"), F.coalesce(F.lower(F.trim("val")), F.lit("")).alias("val"), "pos").where("key <> ''")
        got = bounded_rows(clean.groupBy("kind", "key").agg(F.max_by("val", "pos").alias("val")), T.Lookup.MOST * len(kinds))
        if got is None:
            raise ValueError("the lexicon is too large to travel in a plan")
        return Lexicon(**{f: {r.key: r.val for r in got if r.kind == k} for f, k in kinds.items()})


def labels_of(terms: DataFrame, *, permute_taxa: bool = False) -> DataFrame:
    """(std, key, term_id, label, permuted) of ``terms(term_id, label[, pos])``.

    ``std`` is the label without punctuation, ``key`` its sorted tokens. Of terms with one
    label the last holds. ``permuted`` says whether any order of the tokens matches: not for
    labels of seven tokens and more, nor for taxa, of which there are very many.
    """
    pos = F.col("pos") if "pos" in terms.columns else F.col("id")
    t = terms.select(T.lookup_id("term_id").alias("id"), F.lower("label").alias("label"), *(["pos"] if "pos" in terms.columns else [])).where("label is not null and id is not null")
    t = t.withColumn("std", T.punctuation_treatment("label"))
    last = t.groupBy("std").agg(F.max_by(F.struct(F.col("id").alias("term_id"), "label"), pos).alias("t"), F.min(pos).alias("pos"))
    few = F.size(T.words("std")) < PERMUTED_TOKENS
    return last.select("std", T.canonical_key("std").alias("key"), "t.term_id", "t.label", "pos", (few if permute_taxa else few & ~F.contains("t.term_id", F.lit("ncbitaxon"))).alias("permuted"))



DIRECT, PERMUTED, SYNONYM, SUFFIX = "A Direct Match", "Permutation of Tokens in Resource Term", "Synonym Usage", "Suffix Addition"


def match_table(labels: DataFrame, synonyms: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Everything that a phrase can match, resolved once on the side of the terms.

    Rows (key, text, suffix_mode, via_synonym, suffix_pos, via_permutation, match): a
    phrase matches by its exact ``text``, or where that is null by its sorted tokens
    ``key``. Suffixes are taken off the labels here, instead of being put on each phrase.
    ``synonyms`` has syn and std, the standard label that it stands for.
    """
    l = labels
    direct = l.select(F.col("std").alias("text"), F.lit(False).alias("sfx"), F.lit(-1).alias("sp"), F.lit(False).alias("perm"), "label", "term_id")
    # Of labels with the same tokens the last holds for all orders.
    p = l.where("permuted").groupBy("key").agg(F.max_by(F.struct("label", "term_id"), "pos").alias("t"))
    permuted = p.select(F.col("key").alias("pkey"), "t.label", "t.term_id")
    sfx = F.posexplode(F.array(*map(F.lit, suffixes))).alias("sp", "suffix")
    with_sfx = l.select("std", "label", "term_id", sfx).where("endswith(std, concat(' ', suffix))")
    stems = with_sfx.select(F.expr("substring(std, 1, length(std) - length(suffix) - 1)").alias("text"), F.lit(True).alias("sfx"), "sp", F.lit(False).alias("perm"), "label", "term_id")
    stems = stems.where("text <> ''")
    psfx = permuted.select("pkey", "label", "term_id", sfx)
    tokens, end = F.split("pkey", " "), F.split("suffix", " ")
    rest = F.aggregate(end, tokens, lambda acc, x: T.let(F.array_position(acc, x), lambda i: F.when(F.size(acc) == 0, acc).when(i == 0, F.array().cast("array<string>")).otherwise(F.concat(F.slice(acc, 1, (i - 1).cast("int")), F.slice(acc, (i + 1).cast("int"), F.size(acc))))))
    pstems = psfx.select(F.array_join(rest, " ").alias("pkey"), F.lit(True).alias("sfx"), "sp", "label", "term_id").where("pkey <> ''")
    perms = permuted.select("pkey", F.lit(False).alias("sfx"), F.lit(-1).alias("sp"), "label", "term_id").unionByName(pstems)
    exact = direct.unionByName(stems)
    own = exact.select(T.canonical_key("text").alias("key"), "text", "sfx", F.lit(False).alias("syn"), "sp", "perm", "label", "term_id").unionByName(
        perms.select(F.col("pkey").alias("key"), F.lit(None).cast("string").alias("text"), "sfx", F.lit(False).alias("syn"), "sp", F.lit(True).alias("perm"), "label", "term_id")
    )
    s = synonyms.select("syn", "std", T.canonical_key("std").alias("skey"))
    by_text = s.join(exact, s.std == exact.text).select("syn", "sfx", "sp", "perm", "label", "term_id")
    by_key = s.join(perms, s.skey == perms.pkey).select("syn", "sfx", "sp", F.lit(True).alias("perm"), "label", "term_id")
    syn = by_text.unionByName(by_key).groupBy("syn", "sfx").agg(F.min_by(F.struct("sp", "perm", "label", "term_id"), F.struct("sp", "perm")).alias("m"))
    syn = syn.select(T.canonical_key("syn").alias("key"), F.col("syn").alias("text"), "sfx", F.lit(True).alias("syn"), "m.sp", "m.perm", "m.label", "m.term_id")
    base = F.when(F.col("perm"), F.lit(PERMUTED)).otherwise(F.lit(DIRECT))
    status = F.concat(F.when(F.col("syn"), F.array(F.lit(SYNONYM))).otherwise(F.array().cast("array<string>")), F.when(F.col("sfx"), F.array(F.lit(SUFFIX))).otherwise(F.array().cast("array<string>")), F.array(base))
    return own.unionByName(syn).select(
        "key", "text", F.col("sfx").alias("suffix_mode"), F.col("syn").alias("via_synonym"), F.col("sp").alias("suffix_pos"), F.col("perm").alias("via_permutation"),
        F.struct(F.col("label").alias("term"), F.col("term_id").alias("id"), status.alias("status")).alias("match"),
    )


def lexicon_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(kind, key, val, pos) of a CSV resource: first line skipped, trimmed, lower case, a missing value is ''."""
    raw = spark.read.csv(path, header=False, quote='"', escape='"', schema="key string, val string", mode="PERMISSIVE")
    numbered = raw.withColumn("pos", F.monotonically_increasing_id()).withColumn("_file", F.input_file_name())  # files of a resource are small, so none is read in several parts
    heads = numbered.groupBy("_file").agg(F.min("pos").alias("pos")).select("pos")
    return numbered.join(heads, "pos", "left_anti").select(F.lit(kind).alias("kind"), F.lower(F.trim("key")).alias("key"), F.coalesce(F.lower(F.trim("val")), F.lit("")).alias("val"), "pos").where("key is not null")
