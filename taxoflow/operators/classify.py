"""Classes of matched terms: buckets by hierarchy, default classes by words, ordered rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxoflow.functions import text as T

DEFAULT = "Default classification"


def last_labels(buckets: DataFrame) -> DataFrame:
    """(bucket_id, bucket_label) of ``buckets`` (term_id, label, pos): of two labels for one id the later holds."""
    return buckets.groupBy(F.col("term_id").alias("bucket_id")).agg(F.max_by("label", "pos").alias("bucket_label"))


def path_levels(paths: DataFrame, buckets: DataFrame) -> DataFrame:
    """(node, path, level, bucket_id, bucket_label): the buckets on each path of ``node_paths``, levels from 1.

    ``buckets`` has term_id, label and pos; of two labels for one id the later holds.
    """
    b = last_labels(buckets)
    at = paths.select("node", F.array_join("path", "/").alias("path"), F.posexplode("path").alias("level", "bucket_id"))
    return at.join(b, "bucket_id").select("node", "path", (F.col("level") + 1).alias("level"), "bucket_id", "bucket_label")


def nearest_buckets(levels: DataFrame) -> DataFrame:
    """(node, path, level, bucket_id, bucket_label): of each path the bucket of the lowest level."""
    best = F.min_by(F.struct("level", "bucket_id", "bucket_label"), "level")
    return levels.groupBy("node", "path").agg(best.alias("b")).select("node", "path", "b.level", "b.bucket_id", "b.bucket_label")


def bucket_classes(nearest: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, classes): distinct, sorted classes of a term's nearest buckets; a bucket without a label gives none.

    ``labels`` has bucket_id and label, which may hold several classes split by semicolons.
    """
    j = nearest.select("node", "bucket_id").distinct().join(labels.select("bucket_id", "label"), "bucket_id")
    return j.select("node", F.explode(F.split("label", ";")).alias("c")).distinct().groupBy("node").agg(F.array_sort(F.collect_list("c")).alias("classes"))


def word_set(c: Column | str) -> Column:
    """Distinct singular tokens of a text."""
    return F.array_distinct(F.transform(T.words(c), T.singularize))


def default_classes(samples: DataFrame, phrases: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, phrase, label): the last phrase of which all words are in the sample, as singulars.

    ``phrases`` has phrase, label and pos. The words join by equality and are counted, so no
    sample meets a phrase that it shares no word with.
    """
    p = phrases.select("phrase", "label", "pos", word_set("phrase").alias("w")).where(F.size("w") > 0)
    p = p.select("phrase", "label", "pos", F.size("w").alias("n"), F.explode("w").alias("word"))
    s = samples.select(F.col(key).alias("_k"), F.explode(word_set(F.lower(text))).alias("word"))
    hits = s.join(p, "word").groupBy("_k", "phrase", "label", "pos", "n").agg(F.count("*").alias("m")).where("m = n")
    return hits.groupBy("_k").agg(F.max_by(F.struct("phrase", "label"), "pos").alias("b")).select(F.col("_k").alias(key), "b.phrase", "b.label")


def refining_labels(samples: DataFrame, phrases: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, phrase, label): the first phrase whose tokens are all tokens of the sample, or that stands in it at word boundaries.

    Tokens compare as they stand, in lower case and after the punctuation treatment of the
    sample; a plural is not its singular. The first word of a phrase leads to the samples.
    """
    p = phrases.select("phrase", "label", "pos", T.words("phrase").alias("w"), F.regexp_extract("phrase", r"\w+", 0).alias("lead")).where("lead <> ''")
    s = samples.select(F.col(key).alias("_k"), T.punctuation_treatment(F.lower(text)).alias("_t")).withColumn("_w", T.words("_t"))
    j = s.select("_k", "_t", "_w", F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(r"\w+"), F.lit(0)))).alias("lead")).join(p, "lead")
    inside = F.expr(r"regexp_like(_t, concat('\\b', phrase, '\\b'))")
    ok = j.where((F.size(F.array_except("w", "_w")) == 0) | inside)
    return ok.groupBy("_k").agg(F.min_by(F.struct("phrase", "label"), "pos").alias("b")).select(F.col("_k").alias(key), "b.phrase", "b.label")


@dataclass(frozen=True)
class Rule:
    """One step of an ordered rule list over an array of labels and a text.

    It applies if the labels hold all of ``has``, some of each group of ``some`` and none of
    ``lacks``, equal ``exactly`` if that is given, number ``size`` to ``most``, and the text
    contains some of ``text`` and none of ``no_text``, and its words some of ``words``. Then
    ``remove`` goes (all, if ``clear``; all but these, if ``keep``), and ``add`` is added.
    """

    has: tuple[str, ...] = ()
    some: tuple[tuple[str, ...], ...] = ()
    lacks: tuple[str, ...] = ()
    exactly: tuple[str, ...] | None = None
    size: int = 0
    most: int | None = None
    text: tuple[str, ...] = ()
    no_text: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()
    add: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    clear: bool = False

    def condition(self, labels: Column, text: Column, tokens: Column) -> Column:
        arr = lambda x: F.array(*map(F.lit, x))
        c = F.size(labels) >= self.size
        if self.has:
            c &= F.size(F.array_except(arr(self.has), labels)) == 0
        for group in self.some:
            c &= F.arrays_overlap(labels, arr(group))
        if self.lacks:
            c &= ~F.arrays_overlap(labels, arr(self.lacks))
        if self.exactly is not None:
            c &= F.array_sort(labels) == F.array_sort(arr(self.exactly))
        if self.most is not None:
            c &= F.size(labels) <= self.most
        if self.text:
            c &= F.exists(arr(self.text), lambda x: F.contains(text, x))
        if self.no_text:
            c &= ~F.exists(arr(self.no_text), lambda x: F.contains(text, x))
        if self.words:
            c &= F.arrays_overlap(tokens, arr(self.words))
        return c

    def action(self, labels: Column) -> Column:
        arr = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
        out = arr(()) if self.clear else F.array_intersect(labels, arr(self.keep)) if self.keep else F.array_except(labels, arr(self.remove)) if self.remove else labels
        return F.array_union(out, arr(self.add)) if self.add else out


def apply_rules(labels: Column, text: Column, tokens: Column, rules: Sequence[Rule]) -> Column:
    """Labels after all rules, in their order."""
    for rule in rules:
        labels = T.let(F.coalesce(labels, F.array().cast("array<string>")), _step(rule, text, tokens))
    return labels


def _step(rule: Rule, text: Column, tokens: Column):
    return lambda x: F.when(rule.condition(x, text, tokens), rule.action(x)).otherwise(x)


@dataclass
class Scheme:
    """Tables of a classification; phrases have phrase, label and pos, buckets term_id, label and pos. ``classify_nearest`` needs no paths and no own buckets."""

    paths: DataFrame | None
    own_buckets: DataFrame | None
    third_buckets: DataFrame
    third_labels: DataFrame
    defaults: DataFrame
    refining: DataFrame
    rules: Sequence[Rule] = ()
    priority: Sequence[str] = ()


_BUCKET = "struct<id:string,label:string>"
_LEVELS = f"array<struct<levels:array<struct<level:int,id:string,label:string>>,nearest:{_BUCKET}>>"


def _by_node(paths: DataFrame, buckets: DataFrame, name: str) -> DataFrame:
    """(node, name): for each path with a bucket, in the order of the paths, its levels and its nearest bucket."""
    at = path_levels(paths, buckets).groupBy("node", "path").agg(F.array_sort(F.collect_list(F.struct("level", F.col("bucket_id").alias("id"), F.col("bucket_label").alias("label")))).alias("levels"))
    first = F.get("levels", F.lit(0))
    one = F.struct("path", F.struct("levels", F.struct(first["id"].alias("id"), first["label"].alias("label")).alias("nearest")).alias("x"))
    return at.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(one)), lambda p: p["x"]).cast(_LEVELS).alias(name))


def _shown(bucket: Column) -> Column:
    return F.concat(F.lit("{"), T.py_string(bucket["id"]), F.lit(": "), T.py_string(bucket["label"]), F.lit("}"))


def _bracketed(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]"))


def classify_rows(matched: DataFrame, scheme: Scheme, *, key: str = "row_key") -> DataFrame:
    """``matched`` (see ``match_samples``) with full_list, buckets, third_buckets and classes.

    Classes are those of the nearest third-party buckets; without any, or with only
    ``food``, the default phrase's; then the refining phrase's is added, the rules run and
    a priority class leads. A sample that matched nothing can still get classes.
    """
    terms = _matched_nodes(matched, key)
    both = terms.join(_by_node(scheme.paths, scheme.own_buckets, "own"), "node", "left").join(_by_node(scheme.paths, scheme.third_buckets, "third"), "node", "left")
    flat = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.col(c), F.array().cast(_LEVELS)).alias("v")))), lambda s: s["v"]))
    per = both.groupBy(key).agg(flat("own").alias("_own"), flat("third").alias("_third"))  # a row's terms are few
    j = matched.join(per, key, "left")
    nearest = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast(_LEVELS)), lambda p: p["nearest"]))
    j = _with_classes(j.withColumn("_third", nearest(F.col("_third"))), matched, scheme, key)
    level = lambda x: F.concat(x["level"].cast("string"), F.lit(": "), _shown(x))
    path = lambda p: F.concat(F.lit("{"), F.array_join(F.transform(p["levels"], level), ", "), F.lit("}"))
    own = F.coalesce("_own", F.array().cast(_LEVELS))
    return j.withColumn("full_list", _bracketed(F.transform(own, path))).withColumn("buckets", _bracketed(F.transform(nearest(own), _shown))).drop("_own")


def classify_nearest(matched: DataFrame, nearest: DataFrame, scheme: Scheme, *, key: str = "row_key") -> DataFrame:
    """``matched`` with third_buckets and classes as ``classify_rows`` gives them, without paths.

    ``nearest`` (node, rank, id, label) has each node's nearest third-party buckets, ranked
    as their first paths are.
    """
    per_node = nearest.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "label"))).alias("b"))  # a node's nearest buckets are few
    terms = _matched_nodes(matched, key).join(per_node, "node").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "b"))).alias("t"))
    third = F.array_distinct(F.flatten(F.transform("t", lambda t: F.transform(t["b"], lambda b: F.struct(b["id"].alias("id"), b["label"].alias("label"))))))
    j = matched.join(terms.select(key, third.alias("_third")), key, "left")
    return _with_classes(j.withColumn("_third", F.coalesce("_third", F.array().cast(f"array<{_BUCKET}>"))), matched, scheme, key)


def _matched_nodes(matched: DataFrame, key: str) -> DataFrame:
    return matched.select(key, F.posexplode("matched_raw").alias("pos", "m")).withColumn("node", F.regexp_replace("m", r"(?s)^[^:]*:", ""))


def _with_classes(j: DataFrame, matched: DataFrame, scheme: Scheme, key: str) -> DataFrame:
    """``j``, which is ``matched`` with its nearest buckets in ``_third``, with classes and third_buckets."""
    none = F.array().cast("array<string>")
    labels = scheme.third_labels.select(F.col("bucket_id").alias("_b"), F.col("label").alias("_l"))
    third = j.select(key, F.explode("_third").alias("b")).join(labels, F.col("b.id") == F.col("_b")).groupBy(key).agg(F.array_sort(T.decode_labels(F.collect_list("_l"))).alias("_labels"))
    found = default_classes(matched, scheme.defaults, key=key, text="sample").select(key, F.col("label").alias("_default"))
    fine = refining_labels(matched, scheme.refining, key=key, text="sample").select(key, F.col("label").alias("_fine"))
    j = j.join(third, key, "left").join(found, key, "left").join(fine, key, "left").withColumn("_labels", F.coalesce("_labels", none))
    bare = (F.size("_labels") == 0) | (F.array_join("_labels", "|") == "food")
    j = j.withColumn("_use", bare & F.col("_default").isNotNull())
    j = j.withColumn("_labels", F.when(F.col("_use"), F.array_union("_labels", F.array("_default"))).otherwise(F.col("_labels")))
    j = j.withColumn("_labels", F.when(F.col("_fine").isNotNull(), F.array_union("_labels", F.array("_fine"))).otherwise(F.col("_labels")))
    refined = apply_rules(F.col("_labels"), F.col("sample"), T.words("sample"), scheme.rules)
    shown = F.transform("_third", _shown)
    return (
        j.withColumn("classes", refined)
        .withColumn("classes", T.priority_first(F.col("classes"), list(scheme.priority)) if scheme.priority else F.array_sort("classes"))
        .withColumn("third_buckets", _bracketed(F.when(F.col("_use"), F.concat(shown, F.array(F.lit(f"'{DEFAULT}'")))).otherwise(shown)))
        .drop("_third", "_labels", "_default", "_fine", "_use")
    )
