"""Problem 5: freely typed values mapped to the entries of a reference list.

A multi-pattern automaton holds all names and aliases in compact form (letters and digits only). It runs over
each value's compact form and accepts matches that begin and end at word bounds, so versions, added
words, quotes, split and hyphenated writings do no harm; the longest match that overlaps no longer one
wins. Values without a match go to token-set similarity: an entry is named when each word of its name is
written in the value, in any order, allowing for spelling errors, word endings, abbreviations with a point and
Cyrillic spelling of Latin names. Sharing some words only is not naming.

Likely spellings of a word are found by sets of letters: an error adds or removes one letter of the set at most, or both, so words whose sets
differ in more are passed over in one vector step; the distance
(insertion, deletion, change, swap of neighbours) of the rest is then checked exactly.

Cases: a null or empty value names no entry (0). Of entries with the same name the one of the value's type
is taken, else the one with the smallest id. Of equally similar entries likewise. Entries with a null name
count by their aliases; null and empty aliases are ignored. Values are processed whole. An empty list maps
everything to 0.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.lookalike import LOOKS_LIKE, fold

#: The list is sent to the workers in blocks of so many entries; every block sees every value.
BLOCK = 20_000

# Cyrillic letters in the Latin spelling used for names. Pairs come first.
LATIN_OF = [
    ("кс", "x"), ("куи", "qui"), ("кв", "qu"), ("щ", "shch"), ("ш", "sh"), ("ч", "ch"), ("ц", "ts"), ("ж", "zh"), ("х", "h"), ("ю", "yu"), ("я", "ya"),
    ("а", "a"), ("б", "b"), ("в", "v"), ("г", "g"), ("д", "d"), ("е", "e"), ("ё", "e"), ("з", "z"), ("и", "i"), ("й", "y"),
    ("к", "k"), ("л", "l"), ("м", "m"), ("н", "n"), ("о", "o"), ("п", "p"), ("р", "r"), ("с", "s"), ("т", "t"), ("у", "u"),
    ("ф", "f"), ("ъ", ""), ("ы", "y"), ("ь", ""), ("э", "e"),
]

_CYRILLIC_OF = {b: a for a, b in reversed(LOOKS_LIKE.items()) if "а" <= a <= "я"}
_PART = re.compile(r"[^\W\d_]+|\d+")


def _one_script(word: str) -> str:
    """A word that mixes Cyrillic and Latin letters, in the script most of its letters have."""
    cyr = sum("а" <= c <= "я" or c in "ёіјѕ" for c in word)
    lat = sum("a" <= c <= "z" for c in word)
    if not cyr or not lat:
        return word
    if lat >= cyr:
        return "".join(LOOKS_LIKE.get(c, c) for c in word)
    return "".join(_CYRILLIC_OF.get(c, c) for c in word)


@lru_cache(maxsize=65536)
def _plain(word: str) -> str:
    """A lower-case word without odd characters; Cyrillic stays Cyrillic."""
    if word.isascii():
        return word
    t = unicodedata.normalize("NFKC", word)
    t = "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Mn"))
    return _one_script(t if t.isascii() or any("а" <= c <= "я" for c in t) else fold(t).lower())


def words_of(value: str) -> list[tuple[str, bool]]:
    """(word, whether a point follows at once): runs of letters and runs of digits."""
    out = []
    s = unicodedata.normalize("NFC", value.lower()).replace("™", " ").replace("®", " ")
    for piece in s.split():
        p = _plain(piece)
        for m in _PART.finditer(p):
            out.append((m[0], p[m.end() : m.end() + 1] == "."))
    return out


@lru_cache(maxsize=65536)
def latin(word: str) -> str:
    for a, b in LATIN_OF:
        word = word.replace(a, b)
    return word


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; ``most`` + 1 when larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # What both begin and end with costs nothing.
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    k = 0
    while k < n - i and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[i : len(a) - k], b[i : len(b) - k]
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def allowed(n: int) -> int:
    """Errors allowed in a word of n letters."""
    return 0 if n < 4 else 1 if n < 6 else 2


# Russian endings of adjectives and nouns, longest first.
ENDINGS = [
    "иями", "ями", "ами", "ией", "иям", "ием", "иях", "ого", "его", "ому", "ему", "ыми", "ими", "ой", "ей", "ий", "ый", "ая", "яя", "ое", "ее",
    "ые", "ие", "ую", "юю", "ом", "ем", "ым", "им", "ам", "ям", "ах", "ях", "ых", "их", "ов", "ев", "ия", "ию", "ии", "а", "я", "о", "е", "и", "ы", "у", "ю", "ь",
]


@lru_cache(maxsize=65536)
def stem(word: str) -> str:
    """A Cyrillic word without its ending, as long as four letters stay; other words as they are."""
    if "а" <= word[-1:] <= "я":
        for e in ENDINGS:
            if word.endswith(e) and len(word) - len(e) >= 4:
                return word[: -len(e)]
    return word


def letter_set(word: str) -> int:
    """The letters of a word as bits of one number (several letters may share a bit)."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


class Matcher:
    """Finds the entry that a value names; ``entries`` are (canon_id, name, type, aliases)."""

    def __init__(self, entries: Iterable[tuple[int, str | None, str | None, list | None]]) -> None:
        import ahocorasick

        self.entries = defaultdict(list)  # compact name -> (type, id)
        self.names: dict[str, tuple[str, ...]] = {}
        self.tokens: dict[str, set[str]] = defaultdict(set)  # word of a name -> compact names with it
        for cid, name, kind, aliases in entries:
            for i, n in enumerate([name, *(aliases if aliases is not None else [])]):
                words = tuple(w for w, _ in words_of(n or ""))
                if not words:
                    continue
                compact = "".join(words)
                self.entries[compact].append((kind, cid))
                if i == 0 or compact not in self.names:
                    self.names[compact] = words
        for compact, words in self.names.items():
            for w in words:
                self.tokens[w].add(compact)
        self.stems: dict[str, set[str]] = defaultdict(set)  # stem -> words of names
        for w in self.tokens:
            self.stems[stem(w)].add(w)
        self.roots = [r for r in self.stems if not r.isdigit()]
        self.letters = np.array([letter_set(r) for r in self.roots], np.uint64)
        self.sizes = np.array([len(r) for r in self.roots], np.int64)
        self.errors = np.array([allowed(len(r)) for r in self.roots], np.int64)
        self.longest = max(map(len, self.tokens), default=0)
        self.sorted = sorted(self.tokens)
        self.automaton = ahocorasick.Automaton()
        for compact in self.names:
            self.automaton.add_word(compact, compact)
        if self.names:
            self.automaton.make_automaton()
        self.spelled = lru_cache(maxsize=200_000)(self._spelled)

    def _spelled(self, word: str, cut: bool) -> tuple[tuple[str, float], ...]:
        """Words of names that ``word`` may be a writing of, with the similarity of each."""
        out: dict[str, float] = {}
        for form in {word, latin(word)}:
            if form in self.tokens:
                out[form] = 1.0
            if cut and len(form) >= 3:
                # Words that begin so lie together in the sorted list.
                for i in range(bisect_left(self.sorted, form), len(self.sorted)):
                    t = self.sorted[i]
                    if not t.startswith(form):
                        break
                    if len(t) > len(form):
                        out[t] = max(out.get(t, 0), 0.9)
            root = stem(form)
            if form.isdigit() or len(form) > self.longest + 2:
                continue
            close = np.bitwise_count(self.letters ^ np.uint64(letter_set(root))) <= 2 * self.errors
            close &= np.abs(self.sizes - len(root)) <= self.errors
            for i in np.flatnonzero(close).tolist():
                t = self.roots[i]
                k = distance(root, t, allowed(len(t)))
                if k <= allowed(len(t)):
                    for w in self.stems[t]:
                        out[w] = max(out.get(w, 0), 1 - (k or 0.5 * (form != w)) / len(w))
        return tuple(out.items())

    def _mentions(self, words: list[str]) -> tuple[int, int, str] | None:
        """The longest name or alias written in the words, as whole words: (length, minus its place, name)."""
        text, starts, ends = "".join(words), set(), set()
        at = 0
        for w in words:
            starts.add(at)
            at += len(w)
            ends.add(at)
        best: tuple[int, int, str] | None = None
        for last, name in self.automaton.iter(text):
            a, b = last + 1 - len(name), last + 1
            # Of overlapping matches the longer one wins, of equally long ones the first: so does the longest of all.
            if a in starts and b in ends and (best is None or (len(name), -a) > best[:2]):
                best = (len(name), -a, name)
        return best

    def find(self, value: str | None, kind: str | None) -> tuple[int, float]:
        """(canon_id, similarity); (0, 0.0) when the value names no entry."""
        found = self.ranked(value, kind)
        return found[-1], found[3]

    def ranked(self, value: str | None, kind: str | None) -> tuple[int, int, int, float, bool, int]:
        """(kind of match, length, minus its place, similarity, whether of the type, canon_id): of answers from several lists the
        greatest holds, of equal ones the smallest id."""
        nothing = (0, 0, 0, 0.0, False, 0)
        if not value or not self.names:
            return nothing
        pairs = words_of(value)
        words = [w for w, _ in pairs]
        for how, ws in ((4, words), (3, [latin(w) for w in words])):
            if hit := self._mentions(ws):
                return how, hit[0], hit[1], 1.0, *self._of_type([hit[2]], kind)
        # Token sets: which words of names are written, each with its best similarity.
        got: dict[str, float] = {}
        joined = [(a + b, False) for (a, _), (b, _) in zip(pairs, pairs[1:]) if a.isalpha() and b.isalpha()]
        joined += [(a + b + c, False) for a, b, c in zip(words, words[1:], words[2:]) if (a + b + c).isalpha()]
        for w, cut in pairs + joined:
            for t, s in self.spelled(w, cut):
                got[t] = max(got.get(t, 0), s)
        best: list[str] = []
        top = 0.0
        near = {c for t in got for c in self.tokens[t]}
        for compact in near:
            name = self.names[compact]
            # Words of up to three letters say too little to be asked for; numbers are.
            if all(t in got for t in name if len(t) > 3 or t.isdigit()) and any(len(t) > 3 for t in name):
                score = round(sum(got.get(t, 0) * len(t) for t in name) / len(compact), 6)
                if score > top:
                    best, top = [compact], score
                elif score == top:
                    best.append(compact)
        how = 2
        if not best and len(words) > 1:
            # Blanks at wrong places: runs of words against names that share a word.
            runs = {"".join(words[i:j]) for i in range(len(words)) for j in range(i + 2, min(len(words), i + 8) + 1)}
            for compact in near:
                if len(compact) >= 8 and len(self.names[compact]) > 1 and any(distance(r, compact, 2) <= 2 for r in runs):
                    best.append(compact)
                    how, top = 1, 0.5
        return (how, 0, 0, top, *self._of_type(best, kind)) if best else nothing

    def _of_type(self, names: list[str], kind: str | None) -> tuple[bool, int]:
        other, cid = min((e[0] != kind, e[1]) for n in names for e in self.entries[n])
        return not other, cid


def find_udf(schema: T.StructType, listed: list[tuple]):
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(listed)
        for value, kind in batches:
            yield pd.DataFrame([matcher.ranked(a, b) for a, b in zip(value, kind)], columns=schema.names)

    return F.pandas_udf(find, schema)


def map_values(values: DataFrame, canon: DataFrame, block: int = BLOCK) -> DataFrame:
    """(keyword_id, canon_id) for rows (id, value, type); canon_id is 0 where no entry is named.

    The list travels with the function, in blocks of about ``block`` entries; each block sees all values. Answers of blocks are
    compared as those inside one list are: by the kind of match, then by length and place or by similarity, then the type, then the id.
    """
    n = canon.count()
    blocks = max(1, -(-n // block))
    schema = T.StructType.fromDDL("how int, length int, place int, score double, fits boolean, canon_id long")
    rows = values.where(F.col("id").isNotNull()).select(F.col("id").alias("keyword_id"), "value", "type").distinct()
    listed = canon.select("canon_id", "name", "type", "aliases").distinct()
    answers = None
    for k in range(blocks):
        part = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("canon_id"), F.lit(blocks)) == k)
        entries = [(r["canon_id"], r["name"], r["type"], r["aliases"]) for r in part.collect()]
        found = rows.select("keyword_id", "value", "type", find_udf(schema, entries)("value", "type").alias("f"))
        answers = found if answers is None else answers.unionByName(found)
    if blocks == 1:
        return answers.select("keyword_id", "f.canon_id").distinct()
    rank = F.struct("f.how", "f.length", "f.place", "f.score", "f.fits", (-F.col("f.canon_id")).alias("least"))
    best = answers.groupBy("keyword_id", "value", "type").agg(F.max(rank).alias("b"))
    return best.select("keyword_id", (-F.col("b.least")).alias("canon_id")).distinct()
