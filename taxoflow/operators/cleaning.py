"""The cleaning stage: a text becomes a cleaned phrase with a record of what was done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxoflow.functions import text as T
from taxoflow.operators.lexicon import Lexicon

_STATE = "struct<clean:string,sci:string,micro:array<string>>"
INFLECTION, SPELLING, ABBREVIATION, FOREIGN = (x + " Treatment: " for x in ("Inflection (Plural)", "Spelling Correction", "Abbreviation-Acronym", "Non English Language Words"))


def _log(old: Column, new: Column, what: str, shown: Column) -> Column:
    return F.when(old != new, F.array(F.concat(F.lit(what), shown))).otherwise(F.array().cast("array<string>"))


def lemmas(tokens: Column, lexicon: Lexicon) -> Column:
    """Array of (token, lemma, log) for each token that is neither number nor date."""
    spelling, abbreviations, foreign, exceptions = (T.Lookup(x) for x in (lexicon.spelling, lexicon.abbreviations, lexicon.non_english, lexicon.exceptions))
    kept = F.transform(F.filter(tokens, lambda t: ~T.is_number(t) & ~T.is_date(t)), T.preprocess_token)

    def step(table: T.Lookup, what: str) -> Callable[[Column], Column]:
        return lambda s: T.let(table.get(s["lemma"]), lambda v: F.struct(s["token"].alias("token"), F.coalesce(v, s["lemma"]).alias("lemma"), F.when(v.isNotNull(), F.concat(s["log"], F.array(F.concat(F.lit(what), v)))).otherwise(s["log"]).alias("log")))

    out = F.transform(kept, lambda t: T.let(T.lemma(t, exceptions), lambda x: F.struct(t.alias("token"), x.alias("lemma"), _log(t, x, INFLECTION, t).alias("log"))))
    for table, what in ((spelling, SPELLING), (abbreviations, ABBREVIATION), (foreign, FOREIGN)):
        out = F.transform(out, step(table, what))
    return out


def fold(steps: Column, lexicon: Lexicon) -> Column:
    """Run over lemmas: (clean, sci, micro); a whole prefix is replaced when it is a key."""
    abbreviations, foreign, stop, science = (T.Lookup(x) for x in (lexicon.abbreviations, lexicon.non_english, lexicon.stop_words, lexicon.scientific))

    def phrase(state: Column, table: T.Lookup, what: str) -> Column:
        return T.let(table.get(state["clean"]), lambda v: F.struct(F.coalesce(v, state["clean"]).alias("clean"), F.when(v.isNotNull(), F.concat(state["log"], F.array(F.concat(F.lit(what), v)))).otherwise(state["log"]).alias("log")))

    def clean(acc: Column, s: Column) -> Column:
        added = F.when(stop.has(s["lemma"]), acc["clean"]).when(acc["clean"] == "", s["lemma"]).otherwise(F.concat(acc["clean"], F.lit(" "), s["lemma"]))
        start = T.let(F.regexp_replace(added, " +", " "), lambda x: F.struct(x.alias("clean"), s["log"].alias("log")))
        return T.let(T.let(start, lambda st: phrase(st, abbreviations, ABBREVIATION)), lambda st: phrase(st, foreign, FOREIGN))

    def science_of(acc: Column, s: Column) -> Column:
        note = lambda x: F.coalesce(F.concat(F.lit("  {"), science.get(x), F.lit("}")), F.lit(""))
        added = F.concat(F.when(acc["sci"] == "", s["lemma"]).otherwise(F.concat(acc["sci"], F.lit(" "), s["lemma"])), note(s["lemma"]))
        return F.regexp_replace(T.let(added, lambda x: F.concat(x, note(x))), " +", " ")

    def merge(acc: Column, s: Column) -> Column:
        return T.let(clean(acc, s), lambda c: F.struct(c["clean"].alias("clean"), science_of(acc, s).alias("sci"), F.concat(acc["micro"], c["log"]).alias("micro")))

    return F.aggregate(steps, F.struct(F.lit("").alias("clean"), F.lit("").alias("sci"), F.array().cast("array<string>").alias("micro")).cast(_STATE), merge)


def clean_samples(samples: DataFrame, lexicon: Lexicon, *, text: str = "sample_desc") -> DataFrame:
    """``samples`` with sample, cleaned, cleaned_sci, micro and conversions.

    ``sample`` is the text in lower case without punctuation; ``cleaned`` its normalised
    words without stop words and repeats; ``cleaned_sci`` also names scientific names and
    keeps stop words; ``micro`` logs the treatments in order; ``conversions`` holds (key,
    value) structs of words that changed. A null text is taken as ''.
    """
    base = samples.withColumn("sample", T.punctuation_treatment(F.lower(F.coalesce(F.col(text), F.lit("")))))
    stepped = base.withColumn("_steps", lemmas(T.words("sample"), lexicon))
    folded = stepped.withColumn("_state", fold(F.col("_steps"), lexicon))
    changed = F.transform(F.filter("_steps", lambda s: s["token"] != s["lemma"]), lambda s: F.struct(s["token"].alias("key"), s["lemma"].alias("value")))
    return (
        folded.withColumn("cleaned", T.dedupe_tokens(F.col("_state.clean")))
        .withColumn("cleaned_sci", T.dedupe_tokens(F.col("_state.sci")))
        .withColumn("micro", F.col("_state.micro"))
        .withColumn("conversions", changed)
        .drop("_steps", "_state")
    )


def refine_scientific(sample: Column, cleaned: Column, sci: Column, classes: Column) -> Column:
    """The plain cleaned text where the sample names gallus, or a dog that is no companion animal."""
    dog = F.contains(sample, F.lit("dog")) & ~F.exists(classes, lambda x: F.contains(x, F.lit("companion animal")))
    return F.when(F.contains(sample, F.lit("gallus")) | dog, cleaned).otherwise(sci)
