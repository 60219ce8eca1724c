"""Hand-typed values mapped to a canonical list of terms.

Distinct values are normalised: term ids are read off, numbers, quantities, lot marks,
dates and filler words are taken out, lexicon words translated. What is left, each
sequence of words once however many values gave it, is brought nearer to the words of
the list (a plural, a slip or words typed without a blank lead to the word that they can
only mean) and retrieves candidate names from an inverted index of character n-grams.
Candidates are scored by weighted cosine; those above a threshold and within a margin of
the best are accepted if an exact check finds that the words typed and the words of the
name correspond one to one. Letters inside each n-gram are sorted, so that swapped
letters keep their grams.

Retrieval is exact: a name of at least the threshold must share one of a value's grams
that remain when the most common ones, with together less weight than the threshold,
are left out. Only these postings are read, and only their names are scored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflow.session import bounded_rows, durable

#: Candidates score at least this, and at most ``MARGIN`` less than the best.
THRESHOLD = 0.3
MARGIN = 0.3
TIED = 0.1
#: Terms in one index. A longer list is searched in several passes over the values, with the same results.
NAMES_AT_ONCE = 50_000
#: Rows of the lexicon, which goes whole to every executor.
LEXICON_ROWS = 500_000
_KEYS = 2_000  # bags of n-grams searched at once
_POSTINGS = 2_000_000  # postings added up at once
_MEMO = 500_000
#: Grams that are not read have less than this share of the weight that a candidate needs.
UNREAD = 0.5

_ID = re.compile(r"(?<![a-z0-9])([a-z]{2,10})[\s_:.\-]?(\d{4,12})(?![a-z0-9])")
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_UNIT = r"(?:kgs?|g|gr|mg|lbs?|oz|ml|cl|l|pcs?|pieces?|packs?|units?|boxes|bags|ea)"
_MARKS = re.compile(
    rf"\d{{1,4}}[/.\-]\d{{1,2}}[/.\-]\d{{1,4}}|\d{{1,2}}[\s\-.]+{_MONTH}[\s\-.,]+\d{{2,4}}|{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}"
    rf"|\b(?:lot|batch)\b[\s.:#]*(?:(?:no|nr)\b[\s.:#]*)?[a-z]{{0,3}}-?\d[\w\-]*|#\s*\d+|\bno\.\s*\d+"
    rf"|(?<![a-z0-9])\d+(?:[.,]\d+)?\s*(?:x|{_UNIT})(?![a-z0-9])|(?<![a-z0-9])x\s*\d+(?![a-z0-9])|(?<![a-z0-9])\d+(?:[.,:]\d+)*(?![a-z0-9])"
)
#: Filler that typists add around a name, unless other words are given; a word of the list itself never counts as filler.
FILLER = ("sample", "samples", "approx", "approximately", "about", "ca", "circa", "lot", "batch", "specimen", "unknown", "misc", "item")
_WORD = re.compile(r"[a-z0-9]+")


def fold(text: str) -> str:
    """Lower case without accents and compatibility forms."""
    text = unicodedata.normalize("NFKD", text).lower()
    return "".join(c for c in text if not unicodedata.combining(c))


def words_of(text: str | None) -> tuple[str, ...]:
    return tuple(_WORD.findall(fold(text or "")))


def _forms(word: str) -> set[str]:
    """A word and its plurals."""
    out = {word, word + "s"}
    if word.endswith(("s", "x", "z", "ch", "sh", "o")):
        out.add(word + "es")
    if word.endswith("y"):
        out.add(word[:-1] + "ies")
    if word.endswith(("f", "fe")):
        out.add(word.rstrip("e")[:-1] + "ves")
    if word.endswith("s") and len(word) > 4:
        out.add(word[:-1])
    return out


def within_one(a: str, b: str) -> bool:
    """Whether one letter inserted, left out, changed or swapped with its neighbour makes ``a`` of ``b``; equal counts."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]


def slip(a: str, b: str) -> int:
    """Cost of one slip: 1 for swapped neighbours, which keep all letters and so are the likelier slip, 2 for others."""
    return 1 if len(a) == len(b) and sorted(a) == sorted(b) else 2


class Lexicon:
    """Valid rows of the lexicon: for each key, trimmed and in lower case, the row with the greatest pos."""

    def __init__(self, rows: Iterable[tuple[str, int, str, str | None]], filler: Iterable[str] = FILLER) -> None:
        best: dict[tuple[str, str], tuple[int, str]] = {}
        for kind, pos, key, value in rows:
            if kind is None or key is None or not key.strip():
                continue
            k = (kind, fold(key.strip()))
            if k not in best or (pos or 0) >= best[k][0]:
                best[k] = (pos or 0, value or "")
        self.by_kind: dict[str, dict[str, str]] = defaultdict(dict)
        for (kind, key), (_, value) in best.items():
            self.by_kind[kind][key] = value
        self.translate = {k: words_of(v) for kind in ("abbreviation", "non_english") for k, v in self.by_kind[kind].items()}
        self.stop = set(self.by_kind["stopword"]) | set(filler)


class WholeList:
    """What every part of a list of terms has to know of the whole: its words and the names that each n-gram is in.

    A name, the sorted words of a label or of a valid synonym, lies in one part with all its
    terms. ``read`` gives the (term, label) rows anew at each call.
    """

    def __init__(self, read: Callable[[], Iterable[tuple[str, str | None]]], lexicon: Lexicon, parts: int = 1) -> None:
        self.read, self.parts, self.lexicon = read, parts, lexicon
        synonyms = [(w, tuple(sorted(words_of(value)))) for key, value in lexicon.by_kind["synonym"].items() if (w := tuple(sorted(words_of(key))))]
        wanted = {meant for _, meant in synonyms}
        self.known: set[str] = set()
        by_words: dict[tuple[str, ...], set[str]] = defaultdict(set)
        for term, label in read():
            w = tuple(sorted(words_of(label)))
            if term and w:
                self.known.update(w)
                if w in wanted:
                    by_words[w].add(term)
        self.synonyms: dict[tuple[str, ...], set[str]] = {}
        for w, meant in synonyms:
            if meant in by_words:
                self.synonyms.setdefault(w, set()).update(by_words[meant])
                self.known.update(w)
        self.size = 0
        self.df: Counter = Counter()
        for i in range(parts):
            names = self.names(i)
            self.size += len(names)
            for w in names:
                self.df.update(dict.fromkeys(Index.grams(w), 1))

    def has(self, key: str, part: int) -> bool:
        return self.parts == 1 or zlib.crc32(key.encode()) % self.parts == part

    def names(self, part: int) -> dict[tuple[str, ...], set[str]]:
        """Names of a part and the terms of each."""
        out: dict[tuple[str, ...], set[str]] = defaultdict(set)
        for term, label in self.read():
            w = tuple(sorted(words_of(label)))
            if term and w and self.has(" ".join(w), part):
                out[w].add(term)
        for w, meant in self.synonyms.items():
            if self.has(" ".join(w), part):
                out[w] |= meant
        return out


class Hit(NamedTuple):
    """A name that a value may mean."""

    cost: int
    score: float
    terms: tuple[str, ...]


def meant_hits(hits: list[Hit], best: float) -> list[Hit]:
    """Of all hits of a value those that it means, if ``best`` is the greatest cosine of any name with it."""
    found: list[Hit] = []
    enough = -1.0
    for h in sorted(hits, key=lambda h: -h.score):
        if h.score < max(enough, THRESHOLD, best - MARGIN):
            break
        found.append(h)
        enough = h.score - TIED if h.cost == 0 else enough  # names as exact as this one score nearly the same
    least = min((h.cost for h in found), default=None)
    meant = [h for h in found if h.cost == least]
    return meant if least == 0 or len({h.terms for h in meant}) == 1 else []


class Speller:
    """The words of a whole list, how they may be typed, and the words that a value has."""

    def __init__(self, whole: WholeList) -> None:
        self.lexicon, self.known = whole.lexicon, whole.known
        self.filler = self.lexicon.stop - self.known
        self.variants: dict[str, set[str]] = defaultdict(set)  # exact lexicon spellings of a word
        for key, value in self.lexicon.translate.items():
            if len(value) == 1 and _WORD.fullmatch(key):
                self.variants[value[0]].add(key)
        self.exact: dict[str, set[str]] = defaultdict(set)  # words by their exact spellings
        slips = set()  # spellings that a slip may lead to
        for w in self.known:
            forms = _forms(w)
            slips |= forms
            slips |= {v for v in self.variants.get(w, ()) if len(v) > 4}
            for f in forms | self.variants.get(w, set()):
                self.exact[f].add(w)
        self.foreign = {k: v for k, v in self.lexicon.translate.items() if len(k) > 4 and k in self.lexicon.by_kind["non_english"]}
        self.foreign_forms: dict[str, set[tuple[str, ...]]] = defaultdict(set)
        for k, v in self.foreign.items():
            for f in _forms(k):
                self.foreign_forms[f].add(v)
        self.longest = max(map(len, self.exact), default=0)
        self.spellings = sorted(slips | set(self.foreign_forms))
        pairs = sorted({(_crc(x), i) for i, f in enumerate(self.spellings) for x in _shorter(f)})
        self.left_out = np.array([h for h, _ in pairs], np.int64)
        self.spelling_no = np.array([i for _, i in pairs], np.int64)
        self._memo: dict[str, dict] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memo": {}}

    def _remember(self, kind: str, key: object, make: Callable) -> object:
        memo = self._memo.setdefault(kind, {})
        if key not in memo:
            if len(memo) > _MEMO:
                memo.clear()
            memo[key] = make(key)
        return memo[key]

    def near(self, typed: str) -> list[str]:
        """Spellings at most one slip away, by the letters that one or the other leaves out."""
        h = np.array([_crc(x) for x in _shorter(typed)], np.int64)
        lo, hi = np.searchsorted(self.left_out, h), np.searchsorted(self.left_out, h, "right")
        return [f for i in {int(i) for a, b in zip(lo, hi, strict=True) for i in self.spelling_no[a:b]} if within_one(typed, f := self.spellings[i])]

    def targets(self, typed: str) -> dict[str, int]:
        """Words that ``typed`` can be, with 0 for an exact spelling and the cost of a slip."""
        return self._remember("targets", typed, self._targets)

    def _targets(self, typed: str) -> dict[str, int]:
        out = dict.fromkeys(self.exact.get(typed, ()), 0)
        if not (typed in self.known or typed in self.lexicon.translate or len(typed) < 3):
            for f in self.near(typed):
                for w in self.exact.get(f, ()):
                    if f in _forms(w) or len(f) > 4:
                        out[w] = min(out.get(w, 2), slip(typed, f))
        return out

    def words(self, value: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """What may be term ids in a value, and its words if these are none: (ids, words)."""
        text = fold(value)
        ids = tuple(m[1] + m[2] for m in _ID.finditer(text))
        out: list[str] = []
        for w in _WORD.findall(_MARKS.sub(" ", text)):
            if w in self.filler or w.isdigit():
                continue
            out.extend((w,) if w in self.known else self.lexicon.translate.get(w) or self._remember("foreign", w, self._foreign_slip) or (w,))
        return ids, tuple(out)

    def _foreign_slip(self, typed: str) -> tuple[str, ...] | None:
        """Translation of the one foreign word that is a slip away, if no word of the list is."""
        near = self.near(typed)
        meant = {v for f in near for v in self.foreign_forms.get(f, ())}
        alone = len(meant) == 1 and not any(f in _forms(w) for f in near for w in self.exact.get(f, ()))
        return meant.pop() if alone else None

    def likely(self, typed: str) -> dict[tuple[str, ...], float]:
        """Words of the list that ``typed`` stands for, each with its weight; itself if it stands for none."""
        return self._remember("likely", typed, self._likely)

    def _likely(self, typed: str) -> dict[tuple[str, ...], float]:
        t = self.targets(typed)
        if t:
            some = [w for w, c in t.items() if c == min(t.values())]
            return {(w,): 1 / len(some) for w in some}
        return {self._cut(typed) or (typed,): 1.0}

    def _cut(self, typed: str) -> tuple[str, ...] | None:
        """Words typed without blanks, as few as possible, each in an exact spelling."""
        return self._cut_places(typed)[0]

    def _cut_places(self, typed: str) -> tuple[tuple[str, ...] | None, set[int]]:
        best: list[tuple[tuple[str, ...], tuple[int, ...]] | None] = [((), ())] + [None] * len(typed)
        for end in range(2, len(typed) + 1):
            for start in range(end - 1):
                if best[start] is not None and typed[start:end] in self.exact and (best[end] is None or len(best[start][0]) < len(best[end][0]) - 1):
                    best[end] = ((*best[start][0], min(self.exact[typed[start:end]])), (*best[start][1], end))
        return (None, set()) if best[-1] is None else (best[-1][0], set(best[-1][1]))

    def cost(self, typed: str, word: str) -> int | None:
        """0 if ``typed`` is the word, a plural or a lexicon spelling; what a slip costs if it is one away; else None."""
        return self._remember("cost", (typed, word), self._cost)

    def _cost(self, pair: tuple[str, str]) -> int | None:
        typed, word = pair
        forms = _forms(word)
        variants = self.variants.get(word, set())
        if typed in forms or typed in variants:
            return 0
        if typed in self.known or typed in self.lexicon.translate or len(typed) < 3:
            return None
        return min((slip(typed, f) for f in forms | {v for v in variants if len(v) > 4} if within_one(typed, f)), default=None)

    def merged(self, typed: tuple[str, ...]) -> dict[int, list[tuple[int, tuple[str, ...], int]]]:
        """Words with blanks inside: from the number of the first part to (number behind the last, words, cost)."""
        out: dict[int, list[tuple[int, tuple[str, ...], int]]] = {}
        for at in range(len(typed) - 1):
            text = typed[at]
            for end in range(at + 1, len(typed)):
                text += typed[end]
                if len(text) > self.longest + 1:
                    break
                found = [(end + 1, (w,), c + end - at) for w, c in self.targets(text).items()]
                if found or (cut := self._remember("cut", text, self._cut)) is None:
                    out.setdefault(at, []).extend(found)
                elif not set(accumulate(map(len, typed[at:end]))) & self._cut_ends(text):  # no blank between two of its words
                    out.setdefault(at, []).append((end + 1, cut, end - at))
        return {k: v for k, v in out.items() if v}

    def _cut_ends(self, text: str) -> set[int]:
        """Places where the words of ``_cut`` end, in the text as typed."""
        return self._remember("cut ends", text, lambda t: self._cut_places(t)[1])

    def check(self, typed: tuple[str, ...], name: tuple[str, ...], merged: dict | None = None) -> int | None:
        """Least cost at which the typed words are exactly the words of the name, in any order.

        Each blank too many costs 1, a blank too few nothing. Searched from left to right;
        what is left of the name is remembered, so no order of its words is tried twice.
        """
        merged = self.merged(typed) if merged is None else merged
        if not merged and len(typed) > len(name):
            return None
        memo: dict[tuple[int, int], float] = {}
        whole = (1 << len(name)) - 1
        joins = bool(merged) or len(name) > len(typed)

        def rest(at: int, used: int) -> float:
            if at == len(typed):
                return 0 if used == whole else np.inf
            key = (at, used)
            if key not in memo:
                best = np.inf
                t = self.targets(typed[at])
                for i, w in enumerate(name):
                    if not used >> i & 1 and w in t:
                        best = min(best, t[w] + rest(at + 1, used | 1 << i))
                if joins and len(typed[at]) >= 4:
                    for now, c in self._joined(typed[at], name, used):
                        best = min(best, c + rest(at + 1, now))
                for end, words, c in merged.get(at, ()):
                    now = used
                    for w in words:
                        i = next((i for i, x in enumerate(name) if x == w and not now >> i & 1), None)
                        if i is None:
                            break
                        now |= 1 << i
                    else:
                        best = min(best, c + rest(end, now))
                memo[key] = best
            return memo[key]

        found = rest(0, 0)
        return None if found == np.inf else int(found)

    def _joined(self, text: str, name: tuple[str, ...], used: int) -> list[tuple[int, int]]:
        """Ways in which a text is two or more of the unused words without blanks, in any order: (words used then, cost)."""
        out: dict[int, int] = {}
        seen: dict[tuple[int, int], int] = {}
        work = [(0, used, 0)]
        while work:
            at, now, cost = work.pop()
            for i, w in enumerate(name):
                if now >> i & 1:
                    continue
                then = now | 1 << i
                if at:
                    c = self.cost(text[at:], w)
                    if c is not None and cost + c < out.get(then, 99):
                        out[then] = cost + c
                if len(text) - at < 4 or then.bit_count() == len(name):
                    continue
                for end in {at + n + d for n in self._remember("lengths", w, lambda w: {len(f) for f in _forms(w) | self.variants.get(w, set())}) for d in (-1, 0, 1)}:
                    if at + 2 <= end <= len(text) - 2 and (c := self.cost(text[at:end], w)) is not None and cost + c < seen.get((end, then), 99):
                        seen[end, then] = cost + c
                        work.append((end, then, cost + c))
        return list(out.items())


def _runs(bag: np.ndarray, n: np.ndarray, names: int) -> Iterator[slice]:
    """Slices of grams, whose bags come in order: whole bags, with bounded numbers of postings and of sums where there are several."""
    ends = np.flatnonzero(np.concatenate((bag[1:] != bag[:-1], [True]))) + 1 if len(bag) else []
    total = np.concatenate(([0], np.cumsum(n)))
    start = last = 0
    for end in ends:
        if last > start and (total[end] - total[start] > _POSTINGS or (bag[end - 1] - bag[start] + 1) * names > 2 * _POSTINGS):
            yield slice(start, last)
            start = last
        last = end
    if last > start and total[last] > total[start]:
        yield slice(start, last)


def _crc(x: str) -> int:
    return zlib.crc32(x.encode())


def _shorter(word: str) -> set[str]:
    """A word, and the word without one of its letters."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


class Index:
    """Names of terms and their n-gram postings; of a long list one part."""

    def __init__(self, whole: WholeList, speller: Speller, part: int = 0) -> None:
        self.speller = speller
        self.alone = whole.parts == 1
        names = whole.names(part)
        self.names = list(names)
        self.terms = [tuple(sorted(names[w])) for w in self.names]
        self.exact = [{f for w in name for f in _forms(w) | speller.variants.get(w, set())} for name in self.names]
        self._build(whole.df, whole.size)
        self._near: dict[tuple, tuple[list[int], list[float]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_near": {}}

    @staticmethod
    def grams(words: Iterable[str]) -> Counter:
        out: Counter = Counter()
        for w in words:
            for n in (2, 3):
                for i in range(len(w) - n + 1):
                    out["".join(sorted(w[i : i + n]))] += 1
            if len(w) == 1:
                out[w] += 1
        return out

    def _build(self, df: Counter, size: int) -> None:
        self.gram_no = {g: i for i, g in enumerate(df)}
        self.idf = np.array([np.log(1 + size / n) for n in df.values()]) if df else np.zeros(0)
        self.new_idf = float(np.log(1 + size))
        rows, cols, vals = [], [], []
        for j, w in enumerate(self.names):
            b = self.grams(w)
            g = np.array([self.gram_no[x] for x in b])
            x = np.array(list(b.values()), float) * self.idf[g]
            rows.append(g)
            cols.append(np.full(len(g), j))
            vals.append(x / np.linalg.norm(x))
        g, c, v = (np.concatenate(x) if x else np.zeros(0) for x in (rows, cols, vals))
        self.name_gram, self.name_weight = g.astype(np.int64), v
        self.name_at = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int64)
        order = np.argsort(g, kind="stable")
        self.posting, self.posting_weight = c[order].astype(np.int64), v[order]
        self.at = np.searchsorted(g[order], np.arange(len(df) + 1))

    def _meant(self, words: tuple[str, ...], merged: dict) -> tuple[tuple[tuple[str, ...], float], ...]:
        """The words that are likely meant, with their weights, in a fixed order."""
        out: list[tuple[tuple[str, ...], float]] = []
        i = 0
        while i < len(words):
            w = words[i]
            if i in merged and w not in self.speller.exact:  # blanks inside a word
                i, meant, _ = max(merged[i])
                out.append((meant, 1.0))
                continue
            out.extend(self.speller.likely(w).items())
            i += 1
        return tuple(sorted(out))

    def _nearest(self, meant: list[tuple]) -> None:
        """Remember for each of ``meant`` the names within the margin of its best one: (numbers, cosines), best first."""
        if len(self._near) > _MEMO:
            self._near.clear()
        new = [x for x in dict.fromkeys(meant) if x not in self._near]
        for first in range(0, len(new), _KEYS):
            some = new[first : first + _KEYS]
            bags = []
            for x in some:
                bag: Counter = Counter()
                for words, share in x:
                    for g, n in self.grams(words).items():
                        bag[g] += n * share
                bags.append(bag)
            # most have a name that is the same, or nearly: then only names within the margin of it are read
            high = np.full(len(some), 1 - MARGIN - 1e-9)
            key, name, cosine = self.candidates(bags, high)
            top = np.zeros(len(some))
            np.maximum.at(top, key, cosine)
            again = np.flatnonzero(top - MARGIN < high)
            keep = ~np.isin(key, again)
            more = self.candidates([bags[i] for i in again], np.maximum(THRESHOLD, top[again] - MARGIN))
            key, name, cosine = np.concatenate((key[keep], again[more[0]])), np.concatenate((name[keep], more[1])), np.concatenate((cosine[keep], more[2]))
            order = np.lexsort((name, -cosine, key))
            key, name, cosine = key[order], name[order], cosine[order]
            edges = np.searchsorted(key, np.arange(len(some) + 1))
            for i, x in enumerate(some):
                c = cosine[edges[i] : edges[i + 1]]
                n = np.count_nonzero(c >= c[0] - MARGIN) if len(c) else 0
                self._near[x] = (name[edges[i] : edges[i] + n].tolist(), c[:n].tolist())

    def candidates(self, bags: list[Counter], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the bag, number of the name, cosine) of all pairs with a cosine of at least the bag's ``least``."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        who, gram, weight, strange = [], [], [], np.zeros(len(bags))
        for i, bag in enumerate(bags):
            for g, n in bag.items():
                k = self.gram_no.get(g)
                if k is None:
                    strange[i] += (n * self.new_idf) ** 2
                else:
                    who.append(i)
                    gram.append(k)
                    weight.append(n)
        if not who or not self.names:
            return none  # nothing in common
        i, g = np.array(who, np.int64), np.array(gram, np.int64)
        w = np.array(weight) * self.idf[g]
        w /= np.sqrt(np.bincount(i, w * w, len(bags)) + strange)[i]
        # the most common grams of each bag are not read while their joint weight is clearly below what is wanted
        length = self.at[g + 1] - self.at[g]
        order = np.lexsort((-length, i))
        start = np.searchsorted(i[order], np.arange(len(bags)))[i[order]]
        total = np.concatenate(([0], np.cumsum(w[order] ** 2)))
        left = total[1:] - total[start] < (UNREAD * least[i[order]]) ** 2
        unread = np.sqrt(np.bincount(i[order[left]], w[order[left]] ** 2, len(bags)))
        read = order[~left]
        cell = i * len(self.gram_no) + g
        order = np.argsort(cell)
        found = []
        for x in _runs(i[read], length[read], len(self.names)):
            key, name, part = self._sums(i[read[x]], g[read[x]], w[read[x]], length[read[x]])
            # what is not read adds at most its weight: the others cannot reach what is wanted
            may = part + unread[key] >= least[key] - 1e-9
            key, name = key[may], name[may]
            # cosines of these pairs alone, from the names' own grams
            size = self.name_at[name + 1] - self.name_at[name]
            at = np.repeat(self.name_at[name] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            of = np.repeat(np.arange(len(key)), size)
            wanted = key[of] * len(self.gram_no) + self.name_gram[at]
            place = np.minimum(np.searchsorted(cell, wanted, sorter=order), len(cell) - 1)
            hit = cell[order[place]] == wanted
            cosine = np.bincount(of[hit], self.name_weight[at[hit]] * w[order[place[hit]]], len(key))
            good = cosine >= least[key]
            found.append((key[good], name[good], cosine[good]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none

    def _sums(self, bag: np.ndarray, gram: np.ndarray, weight: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bag, name, sum of products) over the postings of some grams, whose bags come in order."""
        at = np.repeat(self.at[gram] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        low = int(bag[0])
        cell = np.repeat(bag - low, n) * len(self.names) + self.posting[at]
        product = np.repeat(weight, n) * self.posting_weight[at]
        cells = (int(bag[-1]) - low + 1) * len(self.names)
        if 8 * len(cell) > cells:  # adding up in place costs less than sorting
            total = np.bincount(cell, product, cells)
            pair = np.flatnonzero(total)
            return pair // len(self.names) + low, pair % len(self.names), total[pair]
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        return cell[first] // len(self.names) + low, cell[first] % len(self.names), np.add.reduceat(product[order], first)

    def hits(self, keys: list[tuple[str, ...]]) -> Iterator[tuple[int, float, list[Hit]]]:
        """(number of the key, greatest cosine, hits) of each sequence of words that has a candidate.

        Candidates are searched once for all sequences that likely mean the same words.
        Where other parts may have better names, no hit ends the search.
        """
        merges = [self.speller.merged(w) for w in keys]
        meant = [self._meant(w, m) for w, m in zip(keys, merges, strict=True)]
        self._nearest(meant)
        for i, (words, merged) in enumerate(zip(keys, merges, strict=True)):
            names, cosines = self._near[meant[i]]
            if not names:
                continue
            best = cosines[0]
            sure = [w for w in words if w in self.speller.known]  # these are only what they are
            found: list[Hit] = []
            enough = best - MARGIN
            for j, score in zip(names, cosines, strict=True):
                if score < enough:
                    break
                if not merged and not self.exact[j].issuperset(sure) and not len(words) < len(self.names[j]):
                    continue
                if (c := self.speller.check(words, self.names[j], merged)) is not None:
                    found.append(Hit(c, score, self.terms[j]))
                    enough = max(enough, score - TIED) if c == 0 and self.alone else enough
            yield i, best, found


class Mapper:
    """Reading and matching of values on one machine, for a list of one part."""

    def __init__(self, terms: list[tuple[str, str | None]], lexicon: Lexicon) -> None:
        whole = WholeList(lambda: terms, lexicon)
        self.speller = Speller(whole)
        self.index = Index(whole, self.speller)
        self.ids = {plain_id(t): t for t, _ in terms if t}

    def match(self, values: list[str]) -> Iterator[tuple[int, str, float]]:
        """(number of the value, term, score) for all terms that the values mean."""
        read = [self.speller.words(v) for v in values]
        given = [[self.ids[x] for x in ids if x in self.ids] for ids, _ in read]
        rest = [i for i, x in enumerate(given) if not x and read[i][1]]
        for i, x in enumerate(given):
            yield from ((i, t, 1.0) for t in dict.fromkeys(x))
        for k, best, hits in self.index.hits([read[i][1] for i in rest]):
            yield from ((rest[k], t, h.score) for h in meant_hits(hits, best) for t in h.terms)


def plain_id(term: str) -> str:
    return re.sub(r"[^a-z0-9]", "", term.lower())


def typed_values(results: DataFrame, key: str, single: str, several: str) -> DataFrame:
    """(key, field, value, plain) for each value of the text column and of the array column; null and blank values left out.

    ``plain`` is the value in lower case with runs of blanks and separators as one blank.
    """
    one = results.select(F.col(key).alias("key"), F.lit(single).alias("field"), F.col(single).cast("string").alias("value"))
    more = results.select(F.col(key).alias("key"), F.lit(several).alias("field"), F.explode(several).alias("value"))
    plain = F.trim(F.regexp_replace(F.lower("value"), r"[\s_;!?*|\[\]{}\"]+", " "))
    return one.unionByName(more).withColumn("plain", plain).where("plain <> ''")


def map_values(values: DataFrame, terms: DataFrame, lexicon: DataFrame, *, filler: tuple[str, ...] = FILLER) -> DataFrame:
    """(value, term_id, score) for each distinct value of ``values(value)`` that means an entry of ``terms``.

    A value that gives a term id means that term. Otherwise its words must be those of a
    label or of a valid synonym, in any order, each as it is, in the plural, in a spelling
    of the lexicon or one slip away; a slip never turns one known word into another, and
    swapped neighbours are nearer than other slips. If the nearest names differ, the value is ambiguous and means none, but labels of the same words
    are all meant. Values that mean no entry are missing from the result; ``map_results``
    reports them. Nulls and blanks mean none. Values compare exactly, so each is
    read once however often it was typed, and each sequence of words is searched once.
    """
    spark = values.sparkSession
    lexicon_rows = bounded_rows(lexicon.select("kind", "pos", "lex_key", "lex_value"), LEXICON_ROWS)
    if lexicon_rows is None:
        raise ValueError(f"the lexicon has more than {LEXICON_ROWS} rows, each of which every executor would get")
    lex = Lexicon([tuple(r) for r in lexicon_rows], filler)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    passes = max(1, -(-terms.count() // NAMES_AT_ONCE))
    rows = terms.select("term_id", "label")
    whole = WholeList(lambda: ((r.term_id, r.label) for r in rows.toLocalIterator()), lex, passes)
    speller = Speller(whole)
    shared = spark.sparkContext.broadcast(speller)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.words(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i for i, _ in found], pa.list_(pa.string())), pa.array([" ".join(w) for _, w in found], pa.string())], names=["value", "ids", "words"])

    known = values.select("value").where("value is not null").distinct().mapInArrow(read, "value string, ids array<string>, words string")
    known = durable(known)
    ids = terms.where("term_id is not null").select(F.regexp_replace(F.lower("term_id"), "[^a-z0-9]", "").alias("id"), "term_id")
    given = known.select("value", F.explode("ids").alias("id")).join(ids, "id").select("value", "term_id").distinct()
    rest = known.where("words <> ''").join(given.select("value").distinct(), "value", "left_anti").select("value", "words")
    keys = rest.select("words").distinct().repartition(tasks)  # small in bytes, but each costs time
    found = None
    for i in range(passes):
        index = spark.sparkContext.broadcast(Index(whole, speller, i))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                text = b.column(0).to_pylist()
                out = []
                for j, best, hits in index.value.hits([tuple(x.split(" ")) for x in text]):
                    if passes == 1:
                        hits = meant_hits(hits, best)
                    elif best - MARGIN > THRESHOLD:  # a greatest cosine that rules nothing out is not told
                        out.append((text[j], _BEST, best, ()))
                    out += [(text[j], h.cost, h.score, h.terms) for h in hits]
                cols = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.float64(), pa.list_(pa.string())), strict=True)], names=["words", "cost", "score", "terms"])

        part = keys.mapInArrow(search, "words string, cost int, score double, terms array<string>")
        found = part if found is None else found.unionByName(part)
    if passes == 1:
        meant = found.select("words", F.explode("terms").alias("term_id"), "score")
    else:
        every = found.groupBy("words").agg(F.collect_list(F.struct("cost", "score", "terms")).alias("hits"))  # at most the candidates of one value
        meant = every.mapInArrow(_decide, "words string, term_id string, score double")
    return rest.join(meant, "words").select("value", "term_id", "score").unionByName(given.withColumn("score", F.lit(1.0)))


#: Cost that marks a part's greatest cosine, which is no hit.
_BEST = -1


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What words mean, from what all parts of the list have for them."""
    for b in batches:
        out = []
        for words, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            hits = [Hit(r["cost"], r["score"], tuple(r["terms"])) for r in rows if r["cost"] >= 0]
            best = max(r["score"] for r in rows)
            out += [(words, t, h.score) for h in meant_hits(hits, best) for t in h.terms]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()), strict=True)], names=["words", "term_id", "score"])


def map_results(results: DataFrame, terms: DataFrame, lexicon: DataFrame, *, key: str = "result_id", single: str = "sample", several: str = "matched_components", filler: tuple[str, ...] = FILLER) -> tuple[DataFrame, DataFrame]:
    """((key, field, term_id) once each, (key, field, value) of values that mean no entry)."""
    values = durable(typed_values(results, key, single, several))
    mapped = durable(map_values(values.select(F.col("plain").alias("value")), terms, lexicon, filler=filler)).withColumnRenamed("value", "plain")
    found = values.join(mapped, "plain").select("key", "field", "term_id").distinct()
    return found, values.join(mapped.select("plain").distinct(), "plain", "left_anti").select("key", "field", "value")
