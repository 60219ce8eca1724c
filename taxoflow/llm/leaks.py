"""Evaluation passages inside training documents.

Multi-pattern search after Wu and Manber, over words: the patterns are all runs of
``RUN`` words of the test strings. A table gives, for the block of words at a document's
current position, how far the position may move on without missing a pattern; a block
that ends patterns leads to its bucket of patterns, which are then compared word by word
and letter by letter. All documents of an Arrow batch move on together as one vector of
positions. Table and blocks grow with the patterns: there are at least ``SLOTS`` slots for
each different block, and blocks have three words where pairs would be too common.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxoflow.llm.codepoints import Words, mixed

RUN = 15
#: Slots of the shift table for each different block of the patterns.
SLOTS = 8
#: Words of the test strings up to which blocks have two words.
PAIR_WORDS = 200_000
#: Letters of test strings in one search table, about 16 bytes each. More are searched in several passes over the documents.
TABLE_LETTERS = 8_000_000
#: Letters of a batch that are searched at once.
LETTERS_AT_ONCE = 4_000_000

_INLINE = r"</?(?i:b|i|u|s|em|strong|span|font|tt|sub|sup|a|small|big|mark)(?:\s[^<>]*)?/?>|\[/?(?i:b|i|u|s)\]"
_BLOCK = r"</?[A-Za-z!][^<>]*>|\[/?(?i:quote|url|img|size|color|font|code|list|center|left|right|spoiler|email|table|tr|td|li|\*)(?:[=\s][^\[\]]*)?\]"


def bare(text: Column) -> Column:
    """Text without HTML and BBCode tags; those that stand within words leave no gap."""
    return F.regexp_replace(F.regexp_replace(text, _INLINE, ""), _BLOCK, " ")


def _decoded(text: pa.Array) -> pa.Array:
    """Character entities decoded, in the rows that have any."""
    for _ in range(2):  # posts quote posts that were encoded before
        some = pc.match_substring_regex(text, r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z]\w*);")
        if not pc.any(some).as_py():
            break
        text = pc.replace_with_mask(text, some, pa.array([html.unescape(x) for x in text.filter(some).to_pylist()], text.type))
    return text


def _block_key(words: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """Of the block that ends at each place."""
    key = words[at - block + 1]
    with np.errstate(over="ignore"):
        for k in range(block - 2, -1, -1):
            key = mixed(key * np.uint64(31) + words[at - k])
    return key


class Patterns:
    """Shift table and buckets for all runs of ``RUN`` words in the test strings."""

    def __init__(self, strings: list[tuple[object, str]]) -> None:
        strings = [(k, s) for k, s in strings if s is not None]
        self.items = [k for k, _ in strings]
        words = Words(_decoded(pa.array([s for _, s in strings], pa.string())))
        first, end = words.bounds(len(strings))
        self.words, self.owner, self.letters, self.starts, self.ends = words.hash, words.row, words.letters, words.start, words.end
        self.block = 2 if len(self.words) <= PAIR_WORDS else 3
        at = np.arange(self.block - 1, len(self.words))
        at = at[(words.row[at] == words.row[at - self.block + 1]) & ((end - first)[words.row[at]] >= RUN)]
        key = _block_key(self.words, at, self.block)
        place = at - first[words.row[at]]  # the block ends at this word of its string
        self.bits = max(10, int(SLOTS * len(np.unique(key))).bit_length())
        self.shift = np.full(1 << self.bits, RUN - self.block + 1, np.int8)
        np.minimum.at(self.shift, (key >> np.uint64(64 - self.bits)).astype(np.int64), (RUN - 1 - np.minimum(place, RUN - 1)).astype(np.int8))
        last = place >= RUN - 1
        order = np.argsort(key[last], kind="stable")
        self.bucket_key, self.bucket_end = key[last][order], at[last][order]

    def find(self, text: pa.Array) -> Iterator[tuple[int, object]]:
        """Distinct (row, item) of the rows of ``text`` that hold a run of the item."""
        words = Words(_decoded(text))
        first, end = words.bounds(len(text))
        pos = first + RUN - 1
        rows = np.flatnonzero(pos < end)
        pos, stop = pos[rows], end[rows]
        seen: set[tuple[int, int]] = set()
        h = words.hash
        while len(rows):
            key = _block_key(h, pos, self.block)
            move = self.shift[(key >> np.uint64(64 - self.bits)).astype(np.int64)]
            hit = np.flatnonzero(move == 0)
            if len(hit):
                lo, hi = np.searchsorted(self.bucket_key, key[hit]), np.searchsorted(self.bucket_key, key[hit], "right")
                n = hi - lo
                who = np.repeat(hit, n)
                ends = self.bucket_end[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
                same = np.ones(len(who), bool)
                for k in range(RUN):  # compare backwards; most candidates fall out at once
                    i = np.flatnonzero(same)
                    same[i] = h[pos[who[i]] - k] == self.words[ends[i] - k]
                for i in np.flatnonzero(same):
                    pair = (int(rows[who[i]]), int(self.owner[ends[i]]))
                    if pair not in seen and self._equal(words, int(pos[who[i]]), int(ends[i])):
                        seen.add(pair)
            pos = pos + np.maximum(move, 1)
            going = pos < stop
            rows, pos, stop = rows[going], pos[going], stop[going]
        return iter({(r, self.items[o]) for r, o in seen})

    def _equal(self, words: Words, at: int, pattern_at: int) -> bool:
        a = words.letters[words.start[at - RUN + 1] : words.end[at]]
        b = self.letters[self.starts[pattern_at - RUN + 1] : self.ends[pattern_at]]
        return bool(np.array_equal(a, b))


def _slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(text).to_pylist()):
        if i > start and size + n > LETTERS_AT_ONCE:
            yield start, i
            start, size = i, 0
        size += n
    if len(text):
        yield start, len(text)


def leaked_items(documents: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", strings: tuple[str, ...] = ("passage", "question")) -> DataFrame:
    """(doc, item): each document that holds at least ``RUN`` consecutive words of a string of the item.

    Words are runs of letters or digits; case, punctuation, line breaks, quote marks, tags
    and entities do not count. Each pair comes once for each row of ``documents`` that
    holds the item. Null and short texts and strings match nothing; empty tables give no
    rows; an item with a null id is searched as any other. Whole texts are searched.
    """
    spark = documents.sparkSession
    kinds = f"{doc} {documents.schema[doc].dataType.simpleString()}, {item} {items.schema[item].dataType.simpleString()}"
    arrow_item = pa.int64() if items.schema[item].dataType.simpleString() == "bigint" else None
    docs = documents.select(F.col(doc).alias(doc), bare(F.col(text).cast("string")).alias("_text")).where("_text is not null")
    tests = items.select(F.col(item).alias("k"), F.explode(F.array(*(bare(F.col(s).cast("string")) for s in strings))).alias("s")).where("s is not null")
    passes = max(1, -(-(tests.agg(F.sum(F.length("s"))).first()[0] or 0) // TABLE_LETTERS))
    found = None
    for i in range(passes):
        some = tests.where(F.pmod(F.xxhash64("k"), F.lit(passes)) == i) if passes > 1 else tests
        table = spark.sparkContext.broadcast(Patterns([(r.k, r.s) for r in some.toLocalIterator()]))

        def search(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            patterns = table.value
            for b in batches:
                for x, y in _slices(b.column(1)):
                    pairs = list(patterns.find(b.column(1).slice(x, y - x)))
                    ids = b.column(0).slice(x, y - x).take(pa.array([r for r, _ in pairs], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([k for _, k in pairs], arrow_item)], names=[doc, item])

        part = docs.mapInArrow(search, kinds)
        found = part if found is None else found.unionByName(part)
    return found
