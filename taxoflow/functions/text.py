"""Text, token and array expressions. All are built from Spark's own functions."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"(?U)\s+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), _BLANKS, " "))


def punctuation_treatment(c: Column | str) -> Column:
    """The characters - _ ( ) ; / : % and comma become blanks; blanks are collapsed."""
    return collapse(F.regexp_replace(_col(c), r"[-_();/:%,]", " "))


def preprocess_token(c: Column | str) -> Column:
    """Without 's, then without trailing commas, quotes and blanks, then without trailing points and blanks."""
    return F.regexp_replace(F.regexp_replace(F.replace(_col(c), F.lit("'s"), F.lit("")), "[', ]+$", ""), "[. ]+$", "")


def words(c: Column | str) -> Column:
    """Tokens of a text: split at blanks, a final 's and the text's final point as tokens of their own."""
    text = collapse(c)
    text = F.regexp_replace(text, r"(?i)'s(?=\s|$)", " 's")
    text = F.regexp_replace(text, r"([^.\s])\.$", "$1 .")
    return F.filter(F.split(F.regexp_replace(text, r"([!?\[\]{}<>\"])", " $1 "), _BLANKS), lambda x: x != "")


#: Numbers as a float parser that takes underscores between digits reads them, and single fractions.
NUMBER = r"(?i)^\s*[+-]?(?:(?:\d+(?:_\d+)*)?\.?(?:\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?|\d+(?:_\d+)*\.(?:e[+-]?\d+)?|nan|inf|infinity)\s*$|^[¼-¾⅐-⅞⁰¹²³⁴-⁹₀-₉Ⅰ-ⅿ①-⑳]$"
_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DAY = "(?:mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:rs?|rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)"
_NTH = r"\d{1,2}(?:st|nd|rd|th)?"
#: Dates and times: numbers, ordinals, clock times, names of months and days, and dates made of them.
DATE = (
    rf"(?i)^(?:\d{{1,2}}|\d{{4}}|\d{{6}}|\d{{8}}|{_NTH}|\d{{1,2}}\s?(?:am|pm)|\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?:\s?(?:am|pm))?|{_MONTH}|{_DAY}"
    rf"|\d{{1,4}}[-/.]\d{{1,2}}[-/.]\d{{1,4}}|\d{{1,2}}[-/]\d{{2,4}}"
    rf"|(?:{_DAY},?\s+)?{_MONTH}\.?,?\s+{_NTH}(?:,?\s+\d{{2,4}})?|(?:{_DAY},?\s+)?{_NTH}[\s-]+{_MONTH}\.?,?(?:[\s-]+\d{{2,4}})?|{_MONTH}\.?,?\s+\d{{4}})$"
)


def is_number(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(NUMBER), F.lit(False))


def is_date(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(DATE), F.lit(False))


# Plural endings of English, first that matches; public inflection rules.
UNCOUNTABLE = ("equipment", "fish", "information", "jeans", "money", "rice", "series", "sheep", "species")
IRREGULAR = (("people", "person"), ("men", "man"), ("humans", "human"), ("children", "child"), ("sexes", "sex"), ("moves", "move"), ("kine", "cow"), ("zombies", "zombie"))
SINGULAR = (
    (r"(database)s$", "$1"), (r"(quiz)zes$", "$1"), (r"(matr)ices$", "$1ix"), (r"(vert|ind)ices$", "$1ex"), (r"(passer)sby$", "$1by"), (r"^(ox)en", "$1"),
    (r"(alias|status)(es)?$", "$1"), (r"(octop|vir)(us|i)$", "$1us"), (r"^(a)x[ie]s$", "$1xis"), (r"(cris|test)(is|es)$", "$1is"), (r"(shoe)s$", "$1"),
    (r"(o)es$", "$1"), (r"(bus)(es)?$", "$1"), (r"(m|l)ice$", "$1ouse"), (r"(x|ch|ss|sh)es$", "$1"), (r"(m)ovies$", "$1ovie"), (r"(s)eries$", "$1eries"),
    (r"([^aeiouy]|qu)ies$", "$1y"), (r"([lr])ves$", "$1f"), (r"(tive)s$", "$1"), (r"(hive)s$", "$1"), (r"([^f])ves$", "$1fe"),
    (r"(analy|ba|diagno|parenthe|progno|synop|the)(sis|ses)$", "$1sis"), (r"([ti])a$", "$1um"), (r"(n)ews$", "$1ews"), (r"(ss)$", "$1"), (r"s$", ""),
)


#: A word that fits none of these fits no rule above.
ENDINGS = rf"(?i)(?:[sia]|ice|sby|{'|'.join(p for p, _ in IRREGULAR)})$|^oxen"


def singularize(c: Column | str) -> Column:
    """Singular of an English word by the rules above; a word that none fits stays."""
    x = _col(c)
    # most words have none of the endings that the rules are about, so they are told by one test
    out = F.when(~x.rlike(ENDINGS), x)
    out = out.when(x.rlike(rf"(?i)\b(?:{'|'.join(UNCOUNTABLE)})$"), x)
    for plural, single in IRREGULAR:
        out = out.when(x.rlike(rf"(?i){plural}$"), F.regexp_replace(x, rf"(?i){plural}$", single))
    for pattern, new in SINGULAR:
        out = out.when(x.rlike("(?i)" + pattern), F.regexp_replace(x, "(?i)" + pattern, new))
    return out.otherwise(x)


def lemma(c: Column | str, exceptions: Lookup) -> Column:
    """Singular, but not of exceptions, and not of words in -us, -ia and -ta."""
    x = _col(c)
    return F.when(exceptions.has(x) | x.rlike("(?:us|ia|ta)$"), x).otherwise(singularize(x))


class Lookup:
    """A bounded dictionary as a literal: text to text, found by a checksum bin.

    Its entries travel in the plan, so it holds at most ``MOST`` of them; join larger
    dictionaries instead.
    """

    MOST = 20_000

    def __init__(self, entries: Mapping[str, str]) -> None:
        if len(entries) > self.MOST:
            raise ValueError(f"{len(entries)} entries; join a dictionary of more than {self.MOST}")
        self.n = max(1, min(1024, len(entries) // 2))
        bins: list[dict[str, str]] = [{} for _ in range(self.n)]
        for k, v in entries.items():
            bins[zlib.crc32(k.encode()) % self.n][k] = v
        self.empty = not entries
        self.bins = F.from_json(F.lit(json.dumps(bins)), "array<map<string,string>>")

    def get(self, key: Column) -> Column:
        """The value of ``key``, null if there is none."""
        if self.empty:
            return F.lit(None).cast("string")
        return F.try_element_at(F.get(self.bins, F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(self.n)).cast("int")), key)

    def has(self, key: Column) -> Column:
        return F.coalesce(self.get(key).isNotNull(), F.lit(False))


def dedupe_tokens(c: Column | str) -> Column:
    """First occurrences of tokens split at blanks; a doubled ``gallus gallus`` is kept."""
    x = _col(c)
    short = F.trim(F.array_join(F.array_distinct(F.split(x, " ")), " "))
    return F.when(F.contains(x, F.lit("gallus gallus")) & ~F.contains(short, F.lit("gallus gallus")), F.replace(short, F.lit("gallus"), F.lit("gallus gallus"))).otherwise(short)


def canonical_key(c: Column | str) -> Column:
    """Sorted tokens: equal for all permutations of the same tokens."""
    return F.array_join(F.array_sort(F.split(_col(c), " ")), " ")


def ngrams(c: Column | str, n: int) -> Column:
    """Runs of ``n`` tokens of a text split at single blanks; empty if there are fewer."""
    a = F.split(_col(c), " ")
    return let(a, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.slice(t, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>")))


#: Texts of fewer tokens give all combinations in order, longer ones runs only.
COMBINATION_TOKENS = 15


def combinations(tokens: Column, n: int) -> Column:
    """All selections of ``n`` tokens in their order, as arrays of positions counted from 1."""
    return let(
        F.size(tokens),
        lambda size: F.when(size < n, F.array().cast("array<array<int>>")).otherwise(_extend(F.transform(F.sequence(F.lit(1), size), lambda i: F.array(i)), n - 1, size)),
    )


def _extend(arrays: Column, times: int, size: Column) -> Column:
    for _ in range(times):
        arrays = F.flatten(
            F.transform(arrays, lambda a: F.when(F.element_at(a, -1) < size, F.transform(F.sequence(F.element_at(a, -1) + 1, size), lambda i: F.concat(a, F.array(i)))).otherwise(F.array().cast("array<array<int>>")))
        )
    return arrays


def gram_positions(tokens: Column, n: int) -> Column:
    """Positions of the grams of size ``n``: combinations for short texts, else runs."""
    runs = let(F.size(tokens), lambda size: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.sequence(i, i + (n - 1)))).otherwise(F.array().cast("array<array<int>>")))
    return F.when(F.size(tokens) < COMBINATION_TOKENS, combinations(tokens, n)).otherwise(runs)


def take_positions(tokens: Column, positions: Column) -> Column:
    return F.transform(positions, lambda i: F.element_at(tokens, i))


def standard_component(c: Column) -> Column:
    """``label:id`` with the id in upper case; what stands behind a second colon is lost."""
    return F.concat(F.split_part(c, F.lit(":"), F.lit(1)), F.lit(":"), F.upper(F.split_part(c, F.lit(":"), F.lit(2))))


def drop_subsumed(array: Column) -> Column:
    """Labels of which every piece is contained in some other, different label go, also when both go."""
    return F.filter(array, lambda w: ~F.exists(array, lambda o: (o != w) & F.forall(F.split(w, " "), lambda p: F.contains(o, p))))


def retain_phrase(components: Column) -> Column:
    """``label:id`` components, both trimmed: last id for each label, no subsumed labels, distinct and sorted."""
    trimmed = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    parts = F.transform(components, lambda c: F.struct(trimmed(F.regexp_extract(c, r"(?s)^([^:]*):", 1)).alias("label"), trimmed(F.regexp_replace(c, r"(?s)^[^:]*:", "")).alias("id")))

    def kept(split: Column) -> Column:
        last = lambda label: F.concat(label, F.lit(":"), F.element_at(F.filter(split, lambda s: s["label"] == label), -1)["id"])
        return F.transform(let(F.array_distinct(F.transform(split, lambda s: s["label"])), drop_subsumed), last)

    return F.array_sort(F.array_distinct(let(parts, kept)))


def decode_labels(labels: Column) -> Column:
    """Labels that hold several, split at semicolons; distinct."""
    return F.array_distinct(F.flatten(F.transform(labels, lambda x: F.split(x, ";"))))


def priority_first(labels: Column, priority: list[str]) -> Column:
    """Sorted labels, but the smallest of the priority labels first."""
    some = F.array_intersect(labels, F.array(*map(F.lit, priority)))
    return F.when(F.size(some) == 0, F.array_sort(labels)).otherwise(let(F.array_min(some), lambda p: F.concat(F.array(p), F.array_sort(F.array_remove(labels, p)))))


def reorder(array: Column, first: list[str]) -> Column:
    """The elements that ``first`` names, in its order, then the others as they stand."""
    order = F.array(*map(F.lit, first)).cast("array<string>")
    return F.concat(F.filter(order, lambda x: F.array_contains(array, x)), F.filter(array, lambda x: ~F.array_contains(order, x)))


def compact_uri(c: Column | str) -> Column:
    """``prefix:fragment`` of an entity URI: split at its last _, else #, else /."""
    x = _col(c)
    head = F.when(F.contains(x, F.lit("_")), F.regexp_extract(x, r"^(.*)_([^_]*)$", 1)).when(F.contains(x, F.lit("#")), F.regexp_extract(x, r"^(.*)#([^#]*)$", 1)).otherwise(F.regexp_extract(x, r"^(.*)/([^/]*)$", 1))
    tail = F.when(F.contains(x, F.lit("_")), F.regexp_extract(x, r"_([^_]*)$", 1)).when(F.contains(x, F.lit("#")), F.regexp_extract(x, r"#([^#]*)$", 1)).otherwise(F.regexp_extract(x, r"/([^/]*)$", 1))
    prefix = F.regexp_extract(head, r"([^/]*)$", 1)
    return F.when(x.startswith("http") & prefix.rlike("^[A-Za-z]{2}"), F.concat(prefix, F.lit(":"), tail)).otherwise(x)


def expand_id(c: Column | str, prefixes: Lookup) -> Column:
    """URI of ``prefix:fragment`` for known prefixes; others stay."""
    x = _col(c)
    return F.coalesce(F.concat(prefixes.get(F.regexp_extract(x, r"^([^:]*):", 1)), F.regexp_replace(x, r"^[^:]*:", "")), x)


def lookup_id(c: Column | str) -> Column:
    """Lower case, ':' as '_'."""
    return F.lower(F.replace(_col(c), F.lit(":"), F.lit("_")))


def clean_synonyms(c: Column | str) -> Column:
    """Synonyms of a field: split at semicolons and line breaks written as \\n, without double quotes."""
    x = F.replace(F.trim(F.replace(_col(c), F.lit("\\n"), F.lit(";"))), F.lit('"'), F.lit(""))
    return F.split(x, ";")


def py_string(c: Column) -> Column:
    """A text in quotes as Python shows it: double quotes only if it holds a single and no double quote."""
    x = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    x = F.replace(F.replace(F.replace(x, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))


def py_list(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, py_string), ", "), F.lit("]"))


def py_dict(entries: Column) -> Column:
    """Array of (key, value) structs as Python shows a dictionary: last value, first place of a key."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    value = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(py_string(k), F.lit(": "), py_string(value(k)))), ", "), F.lit("}"))


# Confidence ----------------------------------------------------------------------

# Penalties by treatment.
PENALTIES = {
    "used cleaned sample": 5, "inflection (plural) treatment": 3, "synonym usage": 3, "suffix addition": 5, "abbreviation-acronym treatment": 7,
    "non english language words treatment": 7, "a direct match": 0, "permutation of tokens in resource term": 6, "spelling correction treatment": 4,
}


def penalty(statuses: Column, penalties: Mapping[str, int] = PENALTIES) -> Column:
    """Sum, over statuses and rules, of the penalties of the rules that a status mentions."""
    of = lambda s: sum((F.when(F.contains(F.lower(s), F.lit(k)), v).otherwise(0) for k, v in penalties.items()), F.lit(0))
    return F.aggregate(statuses, F.lit(0), lambda acc, s: acc + of(s))


def confidence_level(score: Column) -> Column:
    return F.when(score > 89, "Highest").when(score > 79, "High").when(score > 69, "Moderately High").when(score > 59, "Medium").otherwise("Low")


def confidence(macro: Column, statuses: Column, uncovered: Column, uncovered_heads: Column) -> Column:
    """``level (score%)`` from the macro status, penalties, and tokens and head nouns left uncovered."""
    score = F.when(macro == "Full Term Match", 100 - penalty(statuses)).when(macro == "Component Match", 90 - penalty(statuses) - 6 * F.size(uncovered) - 10 * F.size(uncovered_heads)).otherwise(0)
    return F.concat(confidence_level(score), F.lit(" ("), score.cast("string"), F.lit("%)"))
