"""One form for text that looks the same but consists of different characters.

The text of an Arrow batch is copied into one array of code points. Lookup tables over
all code points give each one's replacement: gathered where it is one code point, by
expansion offsets where it is several, dropped where it is invisible. Combining marks
are then put in order and composed with their letters, by vector operations over the
whole batch. No step calls a string function for a row.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflow.llm.codepoints import code_points
from taxoflow.llm.hot import hot_keys, salted_join
from taxoflow.session import durable

N = sys.maxunicode + 1
#: Compatibility decompositions that keep the look of the text. Others, such as
#: superscripts, fractions or circled letters, look different and are kept.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Ligatures and digraphs look like the letters that they join.
LIGATURES = ((0xFB00, 0xFB06), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F))
# Pairs of look-alike letters, each with the letter that stands for both.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "α": "a", "ι": "i",
    # Armenian and others
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "Օ": "O", "Ս": "U", "ɑ": "a", "ɡ": "g", "ı": "i", "µ": "μ",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Coptic
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X", "ⲭ": "x",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
#: Mathematical letters and digits that have the shape of plain ones: sans-serif and monospace. Bold, slanted and script ones look different.
PLAIN_STYLES = ((0x1D5A0, 0x1D5D3), (0x1D670, 0x1D6A3), (0x1D7E2, 0x1D7EB), (0x1D7F6, 0x1D7FF))
#: Kinds of hyphen; dashes and the minus sign are longer and stay.
HYPHENS = "\u2010\u2011\u00ad\ufe63\uff0d"
#: Joined, separating or empty characters that show nothing.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\u3164\ufeff\uffa0"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its number of replacements, where they start in the pool, the pool, and the combining class."""
    size = np.ones(N, np.int32)
    start = np.arange(N, dtype=np.int32)  # the pool begins with all code points themselves
    pool = [np.arange(N, dtype=np.uint32)]
    klass = np.zeros(N, np.uint8)
    end = N

    def look(c: str) -> str:
        if c in INVISIBLE:
            return ""
        if c in HYPHENS:
            return "-"
        if c in LOOKALIKES:
            return LOOKALIKES[c]
        d = unicodedata.decomposition(c)
        if d:
            tag, _, rest = d.partition(" ") if d[0] == "<" else ("", "", d)
            if not tag or tag in SAME_LOOK or tag in ("<compat>", "<font>") and any(a <= ord(c) <= b for a, b in (LIGATURES if tag == "<compat>" else PLAIN_STYLES)):
                return "".join(look(chr(int(x, 16))) for x in rest.split())
        if unicodedata.category(c) == "Zs" or c in "\t\u2028\u2029":
            return " "
        return c

    for i in range(N):
        if 0xD800 <= i < 0xE000 or 0xAC00 <= i < 0xD7A4 or 0x3400 <= i < 0xA000 or 0x20000 <= i < 0x2F800 or 0x2FA20 <= i < 0xE0000 or 0xE1000 <= i or 0xE000 <= i < 0xF900:
            continue  # surrogates, ideographs, Hangul (kept composed), private use and unassigned planes stand for themselves
        c = chr(i)
        klass[i] = unicodedata.combining(c)
        if 0xFE00 <= i < 0xFE10 or 0xE0000 <= i < 0xE01F0:
            size[i] = 0  # variation selectors and tags
            continue
        new = look(c)
        if new != c:
            size[i], start[i] = len(new), end
            pool.append(np.fromiter(map(ord, new), np.uint32, len(new)))
            end += len(new)
    return size, start, np.concatenate(pool), klass


@cache
def _compositions() -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of (letter, mark) and the composed code points, canonical compositions only."""
    pairs = []
    for i in range(0xC0, N):
        if 0xAC00 <= i < 0xD7A4 or 0xD800 <= i < 0xF900 or 0x20000 <= i:
            continue  # Hangul has a rule of its own; nothing is composed beyond
        d = unicodedata.decomposition(chr(i))
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(i)) == chr(i):
            a, b = (int(x, 16) for x in d.split())
            pairs.append((a << 21 | b, i))
    pairs.sort()
    return np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs], np.uint32)


def _expand(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size, start, pool, _ = _tables()
    n = size[cp]
    if (n == 1).all():
        return pool[start[cp]], row
    at = np.repeat(start[cp].astype(np.int64) - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    return pool[at], np.repeat(row, n)


def _compose(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition, with marks and of Hangul."""
    klass = _tables()[3][cp]
    if (klass > 0).any():
        # A run is a starter with the marks behind it; marks are put in order of class within it.
        run = np.cumsum((klass == 0) | np.concatenate(([True], row[1:] != row[:-1])))
        order = np.lexsort((np.arange(len(cp)), klass, run))
        cp, row = cp[order], row[order]
    while True:  # a few times: what is composed may be composed again
        size = len(cp)
        cp, row = _compose_marks(*_compose_starters(cp, row))
        if len(cp) == size:
            return cp, row


@cache
def _seconds() -> np.ndarray:
    """Code points of class 0 that are composed with the one before."""
    second = np.unique(_compositions()[0] & (1 << 21) - 1)
    return second[_tables()[3][second] == 0]


def _compose_starters(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of which neither is a mark: two and three parts of a Hangul syllable, and some vowel signs."""
    c = cp.astype(np.int64)
    vowel, final = (c >= 0x1161) & (c < 0x1176), (c > 0x11A7) & (c < 0x11C3)
    other = np.isin(c, _seconds())
    if len(cp) < 2 or not (vowel | final | other).any():
        return cp, row
    a, b, together = c[:-1], c[1:], row[1:] == row[:-1]
    lead = together & (a >= 0x1100) & (a < 0x1113) & vowel[1:]
    whole = np.where(lead, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, a)
    made = np.where(lead, whole, -1)
    open_ = together & final[1:] & (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0)
    made = np.where(open_, a + b - 0x11A7, made)
    keys, values = _compositions()
    i = np.flatnonzero(together & other[1:])
    key = a[i] << 21 | b[i]
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    made[i] = np.where(keys[at] == key, values[at], made[i])
    hit = made >= 0
    hit[1:] &= ~hit[:-1]  # a code point takes part in one composition at a time
    out = c.copy()
    out[:-1][hit] = made[hit]
    keep = np.concatenate(([True], ~hit))
    return out[keep].astype(np.uint32), row[keep]


def _compose_marks(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    klass = _tables()[3][cp]
    mark = klass > 0
    if not mark.any():
        return cp, row
    run = np.cumsum(~mark | np.concatenate(([True], row[1:] != row[:-1])))
    keys, made = _compositions()
    alive = np.ones(len(cp), bool)
    first = np.concatenate(([True], run[1:] != run[:-1]))
    head = np.maximum.accumulate(np.where(first, np.arange(len(cp)), 0))  # each mark's starter
    rank = np.arange(len(cp)) - head
    last = np.zeros(len(cp), np.uint8)  # class of the last mark kept in the run
    by_rank = np.argsort(rank, kind="stable")
    edges = np.searchsorted(rank[by_rank], np.arange(1, int(rank.max()) + 2))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        i = by_rank[lo:hi]
        h = head[i]
        key = cp[h].astype(np.int64) << 21 | cp[i]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        fits = (keys[at] == key) & (last[h] < klass[i]) & (klass[h] == 0)
        cp[h[fits]] = made[at[fits]]
        alive[i[fits]] = False
        last[h[~fits]] = klass[i[~fits]]
    return cp[alive], row[alive]


def unify_arrow(text: pa.Array) -> pa.Array:
    """The one form of each text; null stays null."""
    if not len(text):
        return text.cast(pa.string())
    text = text.cast(pa.large_string())
    full = text.fill_null("")
    cp, row = code_points(full)
    cp, row = _expand(cp, row)
    cp, row = _compose(cp, row)
    width = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    out = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    total = np.concatenate(([0], np.cumsum(np.bincount(row, weights=width, minlength=len(full))))).astype(np.int64)
    made = pa.LargeStringArray.from_buffers(len(full), pa.py_buffer(total), pa.py_buffer(out))
    made = pc.if_else(text.is_valid(), made, None) if text.null_count else made
    return made.cast(pa.string())


def _unify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), unify_arrow(b.column(1))], names=["id", "original", "unified"])


def unify(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(id, original, unified) for each row.

    Blanks of all kinds become a blank, hyphens a hyphen-minus; full-width and half-width
    forms, ligatures and look-alike letters become plain letters; invisible characters go;
    marks are composed with their letters. Letter case, accents, punctuation, the number of
    words, and digits against letters are kept. Null gives null, '' gives ''. Other columns
    are not read; repeated rows give repeated rows.
    """
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("id"), F.col(text).cast("string").alias("original")).mapInArrow(_unify_batches, f"id {kind}, original string, unified string")


def same_look(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b): ids of all pairs whose texts look the same though their characters differ, smaller id first.

    Exact copies are no pair. Pairs are made of the different spellings of a look, of which
    there are few, and then given their members; so n exact copies beside one variant cost n,
    as many as the pairs that they are in. Members of a spelling with very many are salted.
    """
    u = durable(unify(rows, key, text).where("unified is not null").select("id", F.unhex(F.md5("unified")).alias("look"), F.unhex(F.md5("original")).alias("spelling")))
    spellings = u.groupBy("look", "spelling").agg(F.count("*").alias("n"))
    several = spellings.groupBy("look").agg(F.count("*").alias("k")).where("k > 1").select("look")
    groups = durable(spellings.join(several, "look", "left_semi"))
    hot = hot_keys(groups, "spelling")  # a spelling has one look
    members = durable(salted_join(u.select("id", "spelling"), groups.select("spelling"), "spelling", hot, "id"))
    one, two = groups.select("look", F.col("spelling").alias("sa")), groups.select("look", F.col("spelling").alias("sb"))
    pairs = one.join(two, "look").where("sa < sb").select(F.col("sa").alias("spelling"), "sb")
    first = salted_join(members, pairs, "spelling", hot, "id").select(F.col("sb").alias("spelling"), F.col("id").alias("other"))
    both = salted_join(members, first, "spelling", hot, "id")
    return both.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
