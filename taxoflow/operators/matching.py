"""Matching cleaned samples to terms: whole, then by components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxoflow.functions import text as T

MATCH = "struct<term:string,id:string,status:array<string>>"
LONGEST_GRAM = 5
CLEANED = "Used Cleaned Sample"


def phrase_tables(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The match table by exact text and by sorted tokens, one row for each, without and with suffixes."""
    rank = F.struct("via_synonym", "suffix_pos", "via_permutation")
    best = lambda mode: F.min_by(F.when(F.col("suffix_mode") == mode, F.struct(rank.alias("rank"), "match")), F.when(F.col("suffix_mode") == mode, rank))
    exact = table.where("text is not null").groupBy("text").agg(best(False).alias("plain"), best(True).alias("suffixed"))
    sorted_ = table.where("text is null").groupBy("key").agg(best(False).alias("plain"), best(True).alias("suffixed"))
    return exact, sorted_


def map_phrases(rows: DataFrame, phrase: str, tables: tuple[DataFrame, DataFrame], out: str) -> DataFrame:
    """``rows`` with ``out`` and ``out_suffixed``: the term that the phrase is, and that it is with a suffix.

    Two joins, whatever the number of suffixes and synonyms; Catalyst broadcasts the tables
    while they are small and shuffles by phrase beyond that.
    """
    exact, sorted_ = tables
    e = exact.select(F.col("text").alias("_t"), F.col("plain").alias("_ep"), F.col("suffixed").alias("_es"))
    s = sorted_.select(F.col("key").alias("_k"), F.col("plain").alias("_sp"), F.col("suffixed").alias("_ss"))
    j = rows.withColumn("_key", T.canonical_key(phrase)).join(e, F.col(phrase) == F.col("_t"), "left").join(s, F.col("_key") == F.col("_k"), "left")
    pick = lambda a, b: F.array_min(F.array_compact(F.array(a, b)))["match"]
    return j.withColumn(out, pick(F.col("_ep"), F.col("_sp"))).withColumn(f"{out}_suffixed", pick(F.col("_es"), F.col("_ss"))).drop("_t", "_k", "_ep", "_es", "_sp", "_ss", "_key")


def full_matches(rows: DataFrame, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``rows`` with ``full``: (stage, match) by the sample, the cleaned sample, then both with suffixes; null for none."""
    m = map_phrases(map_phrases(rows, "sample", tables, "_raw"), "cleaned", tables, "_clean")
    stage = lambda n, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(n).alias("stage"), F.col(c).alias("match")))
    return m.withColumn("full", F.coalesce(stage(1, "_raw"), stage(2, "_clean"), stage(3, "_raw_suffixed"), stage(4, "_clean_suffixed"))).drop("_raw", "_clean", "_raw_suffixed", "_clean_suffixed")


def _known_tokens(texts: DataFrame, table: DataFrame) -> DataFrame:
    """(cleaned, _kept, _size): of each text the tokens that some key of ``table`` has, with their positions, and the number of all."""
    vocabulary = table.select(F.explode(F.split("key", " ")).alias("token")).distinct()
    each = texts.select("cleaned", F.size(F.split("cleaned", " ")).alias("_size"), F.posexplode(F.split("cleaned", " ")).alias("pos", "token"))
    kept = F.array_sort(F.collect_list(F.struct((F.col("pos") + 1).alias("pos"), "token")))  # at most the tokens of one text
    return each.join(vocabulary, "token", "left_semi").groupBy("cleaned").agg(kept.alias("_kept"), F.first("_size").alias("_size"))


def _kept_grams(n: int) -> Column:
    """Selections of ``n`` kept tokens in their order, of long texts only runs without gaps."""
    kept = F.col("_kept")
    none = F.array().cast("array<array<struct<pos:int,token:string>>>")
    some = F.transform(T.combinations(kept, n), lambda a: F.transform(a, lambda i: F.element_at(kept, i)))
    runs = F.when(F.size(kept) >= n, F.transform(F.sequence(F.lit(1), F.size(kept) - n + 1), lambda i: F.slice(kept, i, F.lit(n)))).otherwise(none)
    runs = F.filter(runs, lambda r: F.element_at(r, -1)["pos"] - F.element_at(r, 1)["pos"] == n - 1)
    grams = F.when(F.col("_size") < T.COMBINATION_TOKENS, some).otherwise(runs)
    return F.transform(grams, lambda g: F.struct(F.lit(-n).alias("size"), g["pos"].alias("pos"), g["token"].alias("gram")))


def component_matches(rows: DataFrame, table: DataFrame, *, key: str = "row_key") -> DataFrame:
    """(key, components): the matches of the cleaned sample's grams, longest first, that cover new tokens.

    Each cleaned text is worked on once. Tokens that no key of the table has are left out
    first, for no gram with one of them matches; all grams of up to five of the others are
    then looked up at once by their sorted tokens. Of the orders of a gram's tokens the
    first that matches holds, without a suffix before with one.
    """
    named = rows.select(F.col(key).alias("_row"), "cleaned").where("cleaned <> ''")
    grams = F.concat(*(_kept_grams(n) for n in range(LONGEST_GRAM, 0, -1)))
    g = _known_tokens(named.select("cleaned").distinct(), table).select("cleaned", F.explode(grams).alias("g")).withColumn("_gram", F.col("g.gram"))
    g = g.withColumn("_gkey", F.array_join(F.array_sort("_gram"), " "))
    hit = g.join(table, F.col("_gkey") == F.col("key"))
    order = F.when(F.col("text").isNull(), F.transform("_gram", lambda _x, i: (i + 1).cast("bigint"))).otherwise(F.transform(F.split("text", " "), lambda w: F.array_position(F.col("_gram"), w)))
    rank = F.struct(order.alias("order"), "suffix_mode", "via_synonym", "suffix_pos", "via_permutation")
    best = hit.groupBy("cleaned", "g").agg(F.min_by("match", rank).alias("match"))
    per_text = best.groupBy("cleaned").agg(F.array_sort(F.collect_list(F.struct("g", F.col("g.gram").alias("gram"), "match"))).alias("all"))  # at most the grams of one text

    def cover(acc: Column, x: Column) -> Column:
        known = F.size(F.array_except(x["gram"], acc["covered"])) == 0
        return F.when(known, acc).otherwise(F.struct(F.array_union(acc["covered"], x["gram"]).alias("covered"), F.concat(acc["out"], F.array(x["match"])).alias("out")))

    start = F.struct(F.array().cast("array<string>").alias("covered"), F.array().cast(f"array<{MATCH}>").alias("out"))
    covered = per_text.select("cleaned", F.aggregate("all", start, cover)["out"].alias("components"))
    return named.join(covered, "cleaned").select(F.col("_row").alias(key), "components")


def drop_ancestors(matches: DataFrame, ancestors: DataFrame, *, key: str = "row_key") -> DataFrame:
    """(key, components) without those that are ancestors of another; ``ancestors`` has node and an array of its ancestors."""
    up = ancestors.select(F.col("node").alias("_n"), F.col("ancestors").alias("_a"))
    each = matches.select(key, F.explode("components").alias("c")).join(up, F.col("c.id") == F.col("_n"))
    gone = each.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("_a"))).alias("_gone"))  # a row's components are few
    j = matches.join(gone, key, "left")
    return j.select(key, "components", F.filter("components", lambda c: ~F.coalesce(F.array_contains(F.col("_gone"), c["id"]), F.lit(False))).alias("kept"))


def component_text(c: Column) -> Column:
    return F.concat(c["term"], F.lit(":"), c["id"])


def match_samples(cleaned: DataFrame, table: DataFrame, ancestors: DataFrame | None = None, *, key: str = "row_key") -> DataFrame:
    """``cleaned`` (see ``clean_samples``, with a unique ``key``) with matched, matched_raw, macro and micro.

    ``matched`` has ``label:ID`` strings; ``matched_raw`` the same with ids in lower case.
    Rows that match as a whole take no part in component matching.
    """
    full = full_matches(cleaned, phrase_tables(table))
    parts = component_matches(full.where("full is null").select(key, "cleaned"), table, key=key)
    parts = parts.withColumn("kept", F.col("components")) if ancestors is None else drop_ancestors(parts, ancestors, key=key)
    j = full.join(parts, key, "left")
    none = F.array().cast("array<string>")
    j = j.withColumn("_texts", F.transform(F.coalesce("kept", F.array().cast(f"array<{MATCH}>")), component_text))
    j = j.withColumn("matched_raw", F.when(F.col("full").isNotNull(), F.array(component_text(F.col("full.match")))).when(F.size("_texts") > 0, T.retain_phrase(F.col("_texts"))).otherwise(none))
    # each surviving component once, in the order in which it was found
    start = F.struct(none.alias("seen"), none.alias("notes"))
    note = lambda c: F.concat(F.lit("{"), c["term"], F.lit(": "), T.py_list(c["status"]), F.lit("}"))
    j = j.withColumn("_notes", F.aggregate(F.filter(F.coalesce("components", F.array().cast(f"array<{MATCH}>")), lambda c: F.array_contains(F.col("matched_raw"), component_text(c))), start, lambda acc, c: F.when(F.array_contains(acc["seen"], component_text(c)), acc).otherwise(F.struct(F.concat(acc["seen"], F.array(component_text(c))).alias("seen"), F.concat(acc["notes"], F.array(note(c))).alias("notes"))))["notes"])
    tag = F.when(F.col("full.stage").isin(2, 4), F.array(F.lit(CLEANED))).otherwise(none)
    micro = F.when(F.col("full").isNotNull(), F.concat(tag, "micro", F.col("full.match.status"))).otherwise(F.concat("micro", "_notes"))
    macro = F.when(F.col("full").isNotNull(), "Full Term Match").when(F.size("matched_raw") > 0, "Component Match").otherwise("No Match")
    return j.withColumn("macro", macro).withColumn("micro", micro).withColumn("matched", F.transform("matched_raw", T.standard_component)).drop("full", "components", "kept", "_texts", "_notes")
