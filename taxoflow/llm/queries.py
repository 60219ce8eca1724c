"""Registered queries of the operators for training text."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflow.llm import canonical, copies, leaks, mixing, reading, visual
from taxoflow.session import durable, table

#: Ranks of a public byte-level BPE vocabulary.
TOKENIZER = os.environ.get("TAXOFLOW_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
SAMPLE_FIELDS = ["sample", "sample_2", "sample_3"]


def _mapped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return canonical.map_results(table(spark, d, "match_results"), table(spark, d, "terms"), table(spark, d, "lexicon"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d)[0].withColumnRenamed("key", "result_id")


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d)[1].groupBy("field", "value").agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members = copies.copy_members(table(spark, d, "samples"), "sample_no", SAMPLE_FIELDS)
    return members.where("id <> kept").select(F.col("kept").alias("sample_no_a"), F.col("id").alias("sample_no_b"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(table(spark, d, "samples"), "sample_no", SAMPLE_FIELDS).withColumnRenamed("kept", "sample_no")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return visual.same_look(table(spark, d, "unique_samples"), "entry_no", "sample").select(F.col("a").alias("entry_no_a"), F.col("b").alias("entry_no_b"))


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    u = visual.unify(table(spark, d, "unique_samples"), "entry_no", "sample")
    return u.select(F.col("id").alias("entry_no"), "unified", (~F.col("original").eqNullSafe(F.col("unified"))).alias("changed"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).distinct()


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select("item_id", "suite")
    n = p6_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.join(n, "item_id", "left").fillna(0, ["n_docs"])


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer=TOKENIZER)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares.where("short").select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether the mix keeps its rules, for each target; SQL knows the answers and the size of the whole in documents."""
    mix = _mix(spark, d)
    leaf = mix.rows.groupBy("source", "lang").agg(F.max("n_copies").alias("most"), F.min("n_copies").alias("least"), F.max("n_tokens").alias("longest"))
    per = leaf.groupBy("source").agg(F.max("most").alias("most"), F.max(F.col("most") - F.col("least")).alias("spread"), F.sum("longest").alias("longest"))
    j = mix.shares.join(per, "source", "left").fillna(0, ["most", "spread", "longest"])
    full = F.col("mix_tokens") + F.col("longest") >= F.col("budget")
    return j.select("source", "max_repeats", "docs", "short", (F.col("most") <= F.col("max_repeats")).alias("within_repeats"), (F.col("spread") <= 1).alias("even"), (F.col("mix_tokens") <= F.col("budget")).alias("within_budget"), full.alias("budget_used"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).rows


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents").select("doc_id", "text", "lang"), table(spark, d, "reading_labels"), lang="lang")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    english = table(spark, d, "documents").where("lang = 'en'").select("doc_id", "text")
    return reading.reading_levels(english, table(spark, d, "reading_labels")).where("level = 4").select(F.col("id").alias("doc_id"))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    """Grade and level of every post. Formulas and cut points are made for English; see the README for other languages."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower(F.trim("source")).alias("source"), "lang")
    return durable(_levels(spark, d)).join(docs, "id").select(F.col("id").alias("doc_id"), "source", "lang", "grade", "level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return p8_levels(spark, d).groupBy("source", "lang", "level").agg(F.count("*").alias("n_docs"), F.round(F.avg("grade"), 2).alias("mean_grade"))


QUERIES = {
    "p2_found": p2_found,
    "p2_unmatched": p2_unmatched,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p4_found": p4_found,
    "p4_unified": p4_unified,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p7_mix": p7_mix,
    "p7_kept": p7_kept,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
    "p8_profile": p8_profile,
}

_PLAIN = "nullif(regexp_replace(lower(upper({c})), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '')"
_COPIES = f"""
k AS (SELECT sample_no, list_sort(list_filter([{', '.join(_PLAIN.format(c=c) for c in SAMPLE_FIELDS)}], lambda x: x IS NOT NULL)) AS key FROM samples),
g AS (SELECT key, min(sample_no) AS kept, count(*) AS n FROM k WHERE len(key) > 0 GROUP BY key)"""
# Words of documents and items in order; tags go, and the entities of these tables stand for no letters.
_WORDS = """string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}),
    '</?(?:b|i|u|s|em|strong|span)(?:\\s[^<>]*)?/?>|\\[/?(?:b|i|u|s)\\]', '', 'g'),
    '</?[a-z!][^<>]*>|\\[/?(?:quote|url|img|size|color|font|code|list)(?:[=\\s][^\\[\\]]*)?\\]', ' ', 'g'),
    '&(?:nbsp|amp|gt|lt|quot|#\\d+);', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"""
_LEAKS = f"""
dw AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL),
dr AS (SELECT doc_id, array_to_string(w[i:i + 14], ' ') AS run FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 14)) AS i FROM dw)),
iw AS (SELECT item_id, {_WORDS.format(c='passage')} AS w FROM eval_items UNION ALL SELECT item_id, {_WORDS.format(c='question')} FROM eval_items),
ir AS (SELECT item_id, array_to_string(w[i:i + 14], ' ') AS run FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 14)) AS i FROM iw)),
hits AS (SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run))"""
ORACLE = {
    "p3_found": f"WITH {_COPIES} SELECT kept AS sample_no_a, sample_no AS sample_no_b FROM k JOIN g USING (key) WHERE sample_no <> kept",
    "p3_counts": f"WITH {_COPIES} SELECT kept AS sample_no, n AS n_copies FROM g",
    "p6_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM hits",
    "p6_items": f"WITH {_LEAKS} SELECT i.item_id, i.suite, count(h.doc_id) AS n_docs FROM eval_items i LEFT JOIN hits h USING (item_id) GROUP BY ALL",
    # Any common measure of text gives the same sources; this one counts letters.
    "p7_found": """WITH t AS (SELECT sum(length(text)) AS total FROM documents),
s AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS size FROM documents GROUP BY 1)
SELECT lower(trim(m.source)) AS source FROM mix_targets m LEFT JOIN s ON s.source = lower(trim(m.source)), t
WHERE coalesce(s.size, 0) * m.max_repeats < m.target_share * t.total""",
    "p7_kept": """WITH t AS (SELECT sum(length(text)) AS total FROM documents),
s AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS size, count(*) AS docs FROM documents GROUP BY 1)
SELECT lower(trim(m.source)) AS source, m.max_repeats, coalesce(s.docs, 0) AS docs, coalesce(s.size, 0) * m.max_repeats < m.target_share * t.total AS short,
  true AS within_repeats, true AS even, true AS within_budget, true AS budget_used
FROM mix_targets m LEFT JOIN s ON s.source = lower(trim(m.source)), t""",
}


def _one_form(c: str) -> str:
    """SQL for the one form of a text, over the characters that these tables have."""
    wide = [chr(i) for i in range(0xFF01, 0xFF5F) if i != 0xFF07]  # no quote mark within the SQL text
    pairs = visual.LOOKALIKES | dict(zip("ΆΈΊάί\u212a", "ÁÉÍáíK", strict=True)) | {w: chr(ord(w) - 0xFEE0) for w in wide} | dict.fromkeys("\u00a0\u2007\u202f\u3000", " ") | dict.fromkeys("\u2010\u2011", "-")
    plain = f"translate(replace(replace(replace({c}, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '{''.join(pairs)}', '{''.join(pairs.values())}')"
    return f"nfc_normalize(regexp_replace({plain}, '[\u00ad\u200b\u200c\u200d\u2060\ufeff]', '', 'g'))"


ORACLE["p4_unified"] = f"WITH u AS (SELECT entry_no, sample, {_one_form('sample')} AS unified FROM unique_samples) SELECT entry_no, unified, sample IS DISTINCT FROM unified AS changed FROM u"
ORACLE["p4_found"] = f"""WITH u AS (SELECT entry_no, sample, {_one_form('sample')} AS unified FROM unique_samples WHERE sample IS NOT NULL)
SELECT a.entry_no AS entry_no_a, b.entry_no AS entry_no_b FROM u a JOIN u b USING (unified) WHERE a.entry_no < b.entry_no AND a.sample <> b.sample"""
