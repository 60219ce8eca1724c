"""Reading level of each document, from its author's own words.

Quotes, attributions, signatures and markup are taken out. Sentences, words, letters and
syllables of a whole Arrow batch are counted on arrays of code points; syllables by
hyphenation-style patterns of the document's language, once for each different word.
Five classic formulas give grade estimates, and their median is the document's grade. Grades become
levels by cut points that are fitted to a bounded sample of labelled documents.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflow.llm.codepoints import Words, code_points

#: Labelled rows that the cut points are fitted to, taken in the order of a hash of their document.
LABELLED_ROWS = 20_000
#: Fewer own words than this give no estimate.
LEAST_WORDS = 8
SCHEMA = "sentences int, words int, letters int, syllables int, long_words int, fk double, fog double, smog double, cli double, ari double, grade double"

_QUOTE_TAG = re.compile(r"<(/?)(blockquote)\b[^<>]*>|\[(/?)(quote)\b[^\[\]]*\]", re.I)
_ATTRIBUTION = re.compile(r"^.{1,80}\b(?:wrote|said|schrieb|a écrit|escribió|dijo)\s*:\s*$", re.I)
_SIGNATURE = re.compile(r"^(?:--|_{5,}|\*{5,}|={5,})\s*$")
_RULE = re.compile(r"<hr\s*/?>", re.I)
_SMALL = re.compile(r"\[size=1\](?:(?!\[/size\]).)*\[/size\]", re.I | re.S)
_LINK = re.compile(r"\[(url|img)\b[^\[\]]*\].*?\[/\1\]|https?://\S+|<a\b[^<>]*>.*?</a>", re.I | re.S)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|\[/?[A-Za-z*]+(?:=[^\[\]]*)?\]")
_GONE = re.compile(r"^\W*(?:deleted|removed|post removed|message removed by author)\W*$", re.I)
#: Longest tail that counts as a signature.
SIGNATURE_LETTERS = 400


def _unquoted(text: str) -> str:
    """Without matched quote elements, however nested; unmatched quote tags are only markup."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for m in _QUOTE_TAG.finditer(text):
        close, kind = (m[1], "b") if m[2] else (m[3], "q")
        if not close:
            stack.append((kind, m.start()))
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == kind:
                spans.append((stack[i][1], m.end()))
                del stack[i:]
                break
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out.append(text[at:a])
        at = max(at, b)
    return "\n".join([*out, text[at:]])


def own_words(text: str | None) -> str:
    """The author's own words; '' for null and removed posts."""
    if not text:
        return ""
    text = _unquoted(text)
    last = None
    for last in _RULE.finditer(text):
        pass
    if last and len(text) - last.end() <= SIGNATURE_LETTERS and "\n" not in text[last.end() :].strip():
        text = text[: last.start()]
    text = _SMALL.sub("", text)
    lines = html.unescape(text).split("\n")
    for i, x in enumerate(lines):
        if _SIGNATURE.match(x) and sum(map(len, lines[i:])) <= SIGNATURE_LETTERS:
            lines = lines[:i]
            break
    kept = [x for x in lines if not x.lstrip().startswith((">", "|")) and not _ATTRIBUTION.match(x)]
    text = _TAG.sub(" ", _LINK.sub(" ", "\n".join(kept)))
    return "" if not text.strip() or _GONE.match(text) else text


VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ"
# Hyphenation-style patterns. A digit stands before the letter that it is about; '.' is an edge
# of the word, C a consonant, V a vowel, [..] some and [^..] none of the letters, edges included. The first
# vowel of each run has level 1, all else 0; of all patterns that fit the highest level holds, and letters of
# odd level begin a syllable.
PATTERNS = {
    "en": ("C2e.", "Cl3e.", "C2ed.", "[td]3ed.", "C2es.", "[sxzcghl]3es.", "[^tscgxqV]i1[ao]", "[^tscgxqV]e1o", "[^tscgxqV]u1[ao]"),
    "de": ("[aoöü]1[aoöü]", "a2a", "o2o", "e1um.", "e1[aoöüä]", "[^q]u1[aeoäöü]", "i1[aouäöü]", "ä1[aeio]", "eu1e", "ei1e", "ie1[aou]", "y1[aou]"),
    "fr": ("C2e.", "C2es.", "[^m]2ent.", "é1[aeiouéè]", "[aoi]1é", "V1ï", "a1o", "o1a", "[^gq]u1a", "C[lr]i1[aeo]"),
    "es": ("[aeoáéó]1[aeoáéó]", "[aeoáéó]1[íú]", "[íú]1[aeoáéó]", "u1ú", "i1í"),
}
_SMALL_LETTERS = 0x250


def _letters(some: str) -> np.ndarray:
    out = np.zeros(_SMALL_LETTERS, bool)
    out[[0 if c == "." else ord(c) for c in some.replace("V", VOWELS)]] = True
    return out


@cache
def _patterns(lang: str) -> list[tuple[list[np.ndarray], int, int]]:
    """For each pattern: the letters that fit each place, the place of the digit, and the digit."""
    vowel, edge = _letters("V"), _letters(".")
    out = []
    for pattern in PATTERNS[lang]:
        places, at, level = [], 0, 0
        for token in re.findall(r"\[[^\]]*\]|.", pattern):
            if token.isdigit():
                at, level = len(places), int(token)
            elif token == "C":
                places.append(~vowel & ~edge)
            elif token.startswith("[^"):
                places.append(~_letters(token[2:-1]))
            else:
                places.append(_letters(token.strip("[]")))
        out.append((places, at, level))
    return out


def syllables(words: Words, lang: str = "en") -> np.ndarray:
    """Of each word, by the patterns of a language, or of English where it has none."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    _, first, of = np.unique(words.hash, return_index=True, return_inverse=True)
    size = words.end[first] - words.start[first]
    # the different words one after another, with a 0 before and behind each
    head = np.concatenate(([1], 1 + np.cumsum(size + 1)[:-1]))
    x = np.zeros(int((size + 1).sum()) + 1, np.int64)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    x[np.repeat(head, size) + step] = np.minimum(words.letters[np.repeat(words.start[first], size) + step], _SMALL_LETTERS - 1)
    vowel = _letters("V")[x]
    level = (vowel & ~np.concatenate(([False], vowel[:-1]))).astype(np.int8)
    for places, at, value in _patterns(lang if lang in PATTERNS else "en"):
        n = len(x) - len(places) + 1
        if n <= 0:
            continue
        fits = places[0][x[:n]]
        for k in range(1, len(places)):
            fits = fits & places[k][x[k : k + n]]
        i = np.flatnonzero(fits) + at
        level[i] = np.maximum(level[i], value)
    return np.maximum(np.add.reduceat((level % 2).astype(np.int64), head), 1)[of]


def measures(text: pa.Array, lang: str = "en") -> dict[str, np.ndarray]:
    """Counts and grades for each text without nulls, of one language; grades are NaN below ``LEAST_WORDS``."""
    rows = len(text)
    words = Words(text)
    per = lambda w: np.bincount(words.row, weights=w, minlength=rows)[:rows]
    length = (words.end - words.start).astype(float)
    syl = syllables(words, lang).astype(float)
    n, letters, s, long_words = per(np.ones(len(length))), per(length), per(syl), per((syl >= 3).astype(float))
    cp, row = code_points(text)
    stop = np.isin(cp, [ord(c) for c in ".!?…"])
    after_space = np.ones(len(cp), bool)
    after_space[:-1] = np.isin(cp[1:], [32, 9, 10, 13, 34, 39, 41, 0xBB, 0x201D]) | (row[1:] != row[:-1])
    sentences = np.maximum(np.bincount(row[stop & after_space], minlength=rows)[:rows], 1).astype(float)
    with np.errstate(all="ignore"):
        fk = 0.39 * n / sentences + 11.8 * s / n - 15.59
        fog = 0.4 * (n / sentences + 100 * long_words / n)
        smog = 1.043 * np.sqrt(30 * long_words / sentences) + 3.1291
        cli = 5.88 * letters / n - 29.6 * sentences / n - 15.8
        ari = 4.71 * letters / n + 0.5 * n / sentences - 21.43
        grade = np.median(np.stack([fk, fog, smog, cli, ari]), axis=0)
    short = n < LEAST_WORDS
    out = {"fk": fk, "fog": fog, "smog": smog, "cli": cli, "ari": ari, "grade": grade}
    for v in out.values():
        v[short] = np.nan
    return {"sentences": sentences, "words": n, "letters": letters, "syllables": s, "long_words": long_words} | out


_COUNTS = ("sentences", "words", "letters", "syllables", "long_words")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spoken = pc.fill_null(b.column(2), "en")
        for lang in spoken.unique().to_pylist():
            rows = b.filter(pc.equal(spoken, lang))
            for a in range(0, rows.num_rows, 1000):
                part = rows.slice(a, 1000)
                m = measures(pa.array([own_words(x) for x in part.column(1).to_pylist()], pa.string()), lang)
                cols = [pa.array(v.astype(np.int32)) if k in _COUNTS else pa.array(v, pa.float64(), mask=np.isnan(v)) for k, v in m.items()]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["id", *m])


def grades(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """(id, counts, five grade estimates and their median ``grade``) for each document.

    Syllables follow the language in the column ``lang``; where it is null, not given or has
    no patterns, English. Grades are null for fewer than ``LEAST_WORDS`` own words, as for
    null, empty and removed posts. Whole texts are read. Repeated rows give repeated rows;
    other columns are not read; an empty table gives no rows.
    """
    kind = documents.schema[doc].dataType.simpleString()
    spoken = F.lower(F.trim(F.col(lang))) if lang else F.lit("en")
    known = F.when(spoken.isin(*PATTERNS), spoken).otherwise("en")
    return documents.select(F.col(doc).alias("id"), F.col(text).cast("string").alias("text"), known.alias("lang")).mapInArrow(_measure, f"id {kind}, {SCHEMA}")


def fit_cuts(points: list[tuple[float, int]], levels: tuple[int, ...] = (1, 2, 3, 4)) -> list[float]:
    """Cut points between neighbouring levels, each with the fewest labels on its wrong side; needs a point.

    Of equally good places the middle of the widest gap is taken.
    """
    points = sorted(points)
    g = np.array([p[0] for p in points])
    y = np.array([p[1] for p in points])
    cuts = []
    for level in levels[:-1]:
        low = y <= level
        wrong = np.concatenate(([0], np.cumsum(~low))) + low.sum() - np.concatenate(([0], np.cumsum(low)))
        edge = np.concatenate(([g[0] - 2], g, [g[-1] + 2]))
        real = edge[1:] > edge[:-1]  # equal grades cannot be parted
        best = np.flatnonzero(real & (wrong == wrong[real].min()))
        k = best[np.argmax(edge[best + 1] - edge[best])]
        cuts.append(float(edge[k] + edge[k + 1]) / 2)
    return cuts


def reading_levels(documents: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", lang: str | None = None, label: str = "read_level", limit: int = LABELLED_ROWS) -> DataFrame:
    """(id, grade, level): the level as the annotators use it, 1 easiest; null where the grade is.

    Cut points are fitted to at most ``limit`` labelled rows, chosen by a hash of the
    document's id; every document is graded. Without labels all levels are null.
    """
    some = labels.where(F.col(label).isNotNull()).select(F.col(doc).alias("_doc"), F.col(label).alias("_level")).orderBy(F.xxhash64("_doc"), "_doc", "_level").limit(limit)
    texts = documents.join(some.select(F.col("_doc").alias(doc)).distinct(), doc, "left_semi")
    known = grades(texts, doc=doc, text=text, lang=lang).where("grade is not null").join(some, F.col("id") == F.col("_doc")).select("grade", "_level").collect()
    all_grades = grades(documents, doc=doc, text=text, lang=lang).select("id", "grade")
    if not known:
        return all_grades.withColumn("level", F.lit(None).cast("int"))
    cuts = fit_cuts([(r[0], r[1]) for r in known])
    level = F.lit(1)
    for c in cuts:
        level = level + (F.col("grade") > c).cast("int")
    return all_grades.withColumn("level", F.when(F.col("grade").isNotNull(), level))
