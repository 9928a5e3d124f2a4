"""Problem 3: sentence boundaries across languages and scripts.

Statistics are learned from the corpus itself, per language, without supervision: how often each word has
a period, begins after a sure break (text start, line start, after ! or ?, after a long word with a period), and follows which word. From them
come, by log-likelihood ratios, abbreviations, sentence starters, and words that collocate with a number
and its period (ordinals). Counting and scoring are aggregations; each text then receives only the learned words it
contains, by a join, so no table of words is broadcast or collected.

Each period is classified with these statistics. Lists, quotations, brackets, ellipses, line breaks,
scripts with marks of their own and scripts without any are handled by rule. No boundary falls inside an entity.

Cases: a null, empty or blank text has no sentence. Entities that are null, empty spans, outside of the text or out of order do
no harm. Repeated rows give their sentences once. Texts are processed whole. Offsets are code points, end exclusive,
without white space at both ends; characters without width belong to the sentence before them.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache, lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.lookalike import NO_WIDTH, fold
from spanloom.plans.skew import lookup_join
from spanloom.session import stage

#: Least score of an abbreviation, least ratio of a starter or collocation (99.5 % of chi squared), and the share
#: of clear sentence ends from which a word with a period is taken for a last word instead.
ABBREVIATION = 0.3
RATIO = 7.88
LAST_WORD = 0.9
#: Letters from which a word with a period counts as the end of a sentence while starters are learned.
LONG_WORD = 5

# Frequent words that tell languages of Latin script apart.
FUNCTION_WORDS = {
    "en": "the a an of to and in is on for we you with at before by how about he or our",
    "de": "der die das und ist im in wir sie für auf bei aus mit den dem von zu ein eine seit an",
    "es": "el la los las de del que y en es un una usted le por con para",
    "fr": "le la les des et est un une de du vous nous par au chez à que pour avez",
    "it": "il lo gli di che è un una per con del della sono",
    "pt": "o os as de que e é um uma para com do da no na você",
}
_FUNCTION = {k: set(v.split()) for k, v in FUNCTION_WORDS.items()}

# Marks that end sentences in scripts of their own.
OWN_MARKS = "。！？｡।॥።፧፨։؟۔"
OPENERS = "([{«“„‘‚「『【（〈《‹"
CLOSERS = ")]}»”“’」』】）〉》›\"'"
PAIRS = {"(": ")", "[": "]", "«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "【": "】", "（": "）", "《": "》"}

_BULLET = re.compile(r"[ \t]*(?:[-*•–—·▪◦‣●■]|\d{1,3}[.)]|[^\W\d_][)])[ \t]+(?=\S)")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[.'’\-][\p{L}\p{M}\p{N}]+)*")
# Read backwards from where it ends, so that a long block is not read anew for every period.
_LAST = regex.compile(r"(?r)[\p{L}\p{M}\p{N}]+(?:[.'’][\p{L}\p{M}\p{N}]+)*")
_BLANKS = re.compile(r"\s*")
_GLUED = regex.compile(r"(?<=[\p{L}\p{M}\p{N}]{2})\.(?=\p{Lu}[\p{L}\p{M}])")
_ZERO = {c for a, b in NO_WIDTH for c in range(a, min(b, 0xFFFF) + 1)}


@lru_cache(maxsize=65536)
def word_type(w: str) -> str:
    """The form under which a word is counted; numbers are one type."""
    if w.replace(".", "").replace(",", "").isdigit():
        return "#"
    # Look-alikes are told by case, so they are replaced before and after the case is folded.
    return w.lower() if w.isascii() else fold(fold(w).lower()).lower()


@cache
def _plainer() -> tuple[dict[int, str | None], re.Pattern]:
    """What ``clean`` does to characters, and a pattern of the characters of no width."""
    put: dict[int, str | None] = {0x9: " ", 0xD: " "}
    for o in range(0x80, 0x10000):
        c = chr(o)
        if o in _ZERO:
            put[o] = None
        elif c.isspace():
            put[o] = " "
        elif "０" <= c <= "ｚ" and (d := unicodedata.normalize("NFKC", c)).isalnum():
            put[o] = d
    return put, re.compile("[" + "".join(map(re.escape, map(chr, sorted(_ZERO)))) + "]")


def clean(text: str) -> tuple[str, Sequence[int]]:
    """The text without characters of no width, with plain blanks, and the offset of each character."""
    put, no_width = _plainer()
    s = text.translate(put)
    if not no_width.search(text):
        return s, range(len(text))
    return s, [i for i, c in enumerate(text) if ord(c) not in _ZERO]


def script_of(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latn"
    for low, high, name in _SCRIPTS:
        if low <= o <= high:
            return name
    return "other"


# Blocks of scripts.
_SCRIPTS = [
    (0x370, 0x3FF, "el"), (0x1F00, 0x1FFF, "el"), (0x400, 0x52F, "cyrl"), (0x530, 0x58F, "hy"), (0x590, 0x5FF, "he"), (0x600, 0x77F, "arab"),
    (0x900, 0x97F, "deva"), (0x980, 0xDFF, "indic"), (0xE00, 0xE7F, "thai"), (0xE80, 0xEFF, "lao"), (0x1000, 0x109F, "mymr"), (0x10A0, 0x10FF, "ka"),
    (0x1200, 0x139F, "ethi"), (0x1780, 0x17FF, "khmr"), (0x3040, 0x30FF, "ja"), (0x3400, 0x9FFF, "hani"), (0xAC00, 0xD7AF, "ko"),
]


@lru_cache(maxsize=65536)
def _scripts(w: str) -> tuple[tuple[str, int], ...]:
    """Letters of a word by script. A word of several scripts that look alike has none."""
    n = Counter(map(script_of, w))
    return () if len(n) > 1 and "latn" in n and ("cyrl" in n or "el" in n) else tuple(n.items())


@lru_cache(maxsize=65536)
def _small(w: str) -> str:
    return w.lower() if w.isascii() else fold(w).lower()


_LETTERS = re.compile(r"[^\W\d_]+")


def language(text: str) -> str:
    """A script, or for Latin script the language whose function words are most frequent."""
    n: Counter[str] = Counter()
    found = _LETTERS.findall(text)
    for w in found:
        for script, k in _scripts(w):
            n[script] += k
    own = {k: v for k, v in n.items() if k not in ("latn", "other")}
    if own and (sum(own.values()) >= 0.15 * sum(n.values())):
        if own.get("ja"):
            return "ja"
        return max(own, key=lambda k: (own[k], k))
    words = list(map(_small, found))
    votes = {k: sum(w in f for w in words) for k, f in _FUNCTION.items()}
    best = max(votes, key=lambda k: (votes[k], k == "en"))
    return best if votes[best] else "en"


def observe(text: str) -> tuple[str, list[tuple[str, bool, bool]], list[tuple[str, str, str]]]:
    """(language, [(word, has period, after a sure break)], [(word with period, next word, kind)])."""
    s, _ = clean(text)
    # A period before a capital with the blank missing parts two words, but is no sure break: names have such points too.
    s = _GLUED.sub(".\x1f ", s)
    tokens = list(_TOKEN.finditer(s))
    words, pairs = [], []
    for k, m in enumerate(tokens):
        gap = s[tokens[k - 1].end() : m.start()] if k else ""
        sure = not k or "\n" in gap or any(c in "!?…" or c in OWN_MARKS for c in gap.rstrip(OPENERS + " \"'-—–*•¿¡"))
        if k and not sure and gap.startswith(". ") and len(tokens[k - 1][0]) >= LONG_WORD and tokens[k - 1][0].isalpha():
            sure = True  # a long word is hardly ever cut short
        w = word_type(m[0])
        period = s[m.end() : m.end() + 1] == "." and s[m.end() + 1 : m.end() + 2] != "."
        words.append((w, period, sure))
        if period:
            after = m.end() + 1
            at = _BLANKS.match(s, after).end()
            if at == len(s) or "\n" in s[after:at]:
                pairs.append((w, "", "end"))
            elif s[after] == " " and k + 1 < len(tokens):
                t = tokens[k + 1][0]
                first = s[at]
                up = (t[0].isupper() or first in OPENERS + "\"¿¡") and not first.islower() and first not in ",;:-—–"
                pairs.append((w, word_type(t), "up" if up else "low"))
    return language(s), words, pairs


OBSERVED = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("words", T.ArrayType(T.StructType([T.StructField("w", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("p", T.IntegerType()), T.StructField("s", T.IntegerType())]))),
        T.StructField("pairs", T.ArrayType(T.StructType([T.StructField("w", T.StringType()), T.StructField("v", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("n", T.IntegerType())]))),
    ]
)


@F.pandas_udf(OBSERVED)
def observe_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for t in texts:
            lang, words, pairs = observe(t or "")
            n, p, s = Counter(), Counter(), Counter()
            for w, period, sure in words:
                n[w] += 1
                p[w] += period
                s[w] += sure
            rows.append((lang, [(w, c, p[w], s[w]) for w, c in n.items()], [(*k, c) for k, c in Counter(pairs).items()]))
        yield pd.DataFrame(rows, columns=OBSERVED.names)


def _log(k: Column, n: Column, p: Column) -> Column:
    """k ln p + (n - k) ln(1 - p), with 0 ln 0 = 0."""
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return k * F.log(q) + (n - k) * F.log(1 - q)


def _ratio(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Log-likelihood ratio of b following a, from the counts of a, b, both, and all."""
    p, p1, p2 = b / n, ab / a, (b - ab) / F.greatest(n - a, F.lit(1.0))
    return -2 * (_log(ab, a, p) + _log(b - ab, n - a, p) - _log(ab, a, p1) - _log(b - ab, n - a, p2))


def learn(observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((lang, w, abbr, start), (lang, w, v) ordinals) from rows (lang, words, pairs)."""
    words = (
        observed.select("lang", F.inline("words"))
        .groupBy("lang", "w")
        .agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "p", "s")])
    )
    words = stage(words, "words")
    total = words.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("p").alias("periods"), F.sum("s").alias("starts"))
    words = words.join(F.broadcast(total), "lang")  # one row a language: at most the scripts and languages named above
    bare = F.regexp_replace("w", r"\.", "")
    inner = F.length("w") - F.length(bare)
    # A word with a period almost always, against a word with one by chance.
    likely = -2 * (_log(F.col("p"), F.col("n"), F.col("periods") / F.col("all")) - _log(F.col("p"), F.col("n"), F.lit(0.99)))
    score = likely * F.exp(-F.length(bare)) * (inner + 1) * F.pow(F.greatest(F.length(bare), F.lit(1)).cast("double"), -(F.col("n") - F.col("p")))
    start = (F.col("s") > 0) & (F.col("s") / F.col("n") > F.col("starts") / F.col("all")) & (_ratio(F.col("starts"), F.col("n"), F.col("s"), F.col("all")) >= RATIO)
    types = stage(words.select("lang", "w", "n", "p", "all", ((F.col("w") != "#") & (F.col("p") > 0) & (score >= ABBREVIATION)).alias("abbr"), ((F.col("w") != "#") & start).alias("start")), "types")

    pairs = stage(observed.select("lang", F.inline("pairs")).groupBy("lang", "w", "v", "kind").agg(F.sum("n").cast("double").alias("k")), "pairs")
    follows = pairs.join(types.where("start").select("lang", F.col("w").alias("v"), "start"), ["lang", "v"], "left")
    ends = follows.groupBy("lang", "w").agg((F.sum(F.when((F.col("kind") == "end") | ((F.col("kind") == "up") & F.col("start")), F.col("k")).otherwise(0.0)) / F.sum("k")).alias("final"))
    learned = types.where("abbr or start").join(ends, ["lang", "w"], "left").select(
        "lang", "w", (F.col("abbr") & (F.coalesce("final", F.lit(0.0)) < LAST_WORD)).alias("abbr"), "start"
    ).where("abbr or start")
    number = pairs.where("w = '#' and kind = 'up'").join(types.where("not start").select("lang", F.col("w").alias("v"), F.col("n").alias("n_v"), "all"), ["lang", "v"])
    number = number.join(F.broadcast(types.where("w = '#'").select("lang", F.col("p").alias("n_w"))), "lang")  # one row a language
    ordinal = number.where((F.col("k") / F.col("n_v") > F.col("n_w") / F.col("all")) & (_ratio(F.col("n_w"), F.col("n_v"), F.col("k"), F.col("all")) >= RATIO))
    return learned, ordinal.select("lang", "v").distinct()


_PAIRED = re.compile("[\n\"" + re.escape("".join(PAIRS) + "".join(PAIRS.values())) + "]")


def _ranges(s: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(opening, closing) places of quotations and brackets, outermost only, closed within the same paragraph."""
    out, stack, straight = [], [], -1
    blocked = lambda i: any(a <= i < b for a, b in spans)
    for m in _PAIRED.finditer(s):
        i, c = m.start(), m[0]
        if c == "\n" and s[i : i + 2] == "\n\n":
            stack, straight = [], -1
        elif c == '"':
            if straight >= 0:
                out.append((straight, i))
                straight = -1
            elif i == 0 or s[i - 1].isspace() or s[i - 1] in OPENERS + "-—":
                straight = i
        elif stack and c in stack[-1][1]:
            out.append((stack.pop()[0], i))
        elif c in PAIRS and not blocked(i):
            stack.append((i, PAIRS[c]))
    out.sort()
    top: list[tuple[int, int]] = []
    for a, b in out:
        if not top or a > top[-1][1]:
            top.append((a, b))
    return top


def _blocks(s: str) -> list[tuple[int, int, bool]]:
    """(start, end, is item): running prose, and list items with the lines that continue them."""
    out: list[list] = []
    listed = False  # whether a bullet here continues a list
    at = 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", s):
        end = at + len(line)
        body = line.strip()
        if not body:
            if out:
                out[-1][1] = end
            at = end
            continue
        if _BULLET.match(line) and listed:
            out.append([at, end, True])
        elif out and out[-1][2]:
            before = s[out[-1][0] : at].rstrip()
            if body[0].islower() and before[-1] not in ";.!?:":
                out[-1][1] = end
            else:
                out.append([at, end, False])
                listed = False
        elif out:
            out[-1][1] = end
            listed = False
        else:
            out.append([at, end, False])
        if body.endswith((":", "：")):
            listed = True
        at = end
    return [tuple(b) for b in out]


def split(text: str, spans: list[tuple[int, int]], lang: str, abbr: set[str], start: set[str], ordinal: set[str]) -> list[tuple[int, int]]:
    """Sentences of a text as (start, end)."""
    s, at = clean(text)
    if not s.strip():
        return []
    inner = sorted((bisect_right(at, a - 1), bisect_right(at, b - 1)) for a, b in spans if a < b)
    ranges = _ranges(s, inner)
    cuts = {0}
    for a, b, item in _blocks(s):
        cuts.add(a)
        if not item:
            cuts.update(c for c in _prose(s, a, b, inner, ranges, lang, abbr, start, ordinal))
            # The heading of a list is the last line of its block.
            if s[b : b + 1] and _BULLET.match(s, b) and s[a:b].rstrip().endswith((":", "：")):
                line = s.rfind("\n", a, a + len(s[a:b].rstrip()))
                if line >= a:
                    head = s[line + 1 : b].lstrip()
                    if head[:1].isupper() or not head[:1].isalpha():
                        cuts.add(line + 1)
    if lang in ("thai", "lao", "khmr"):
        # No marks end sentences here; a blank before a letter of the script does.
        cuts.update(m.end() for m in re.finditer(r"\s+(?=[\u0E01-\u0EDF\u1780-\u17B3])", s) if not any(x <= m.start() <= y for x, y in ranges))
    bounds = sorted(c for c in cuts if c < len(s) and not any(x < c < y for x, y in inner)) + [len(s)]
    out = []
    places = [0, *(at[c] for c in bounds[1:-1]), len(text)]
    for x, y in zip(places, places[1:]):
        piece = text[x:y]
        left = len(piece) - len(piece.lstrip())
        if piece.strip():
            # Characters without width at the start of a piece belong to the sentence before.
            out.append((x + left, x + len(piece.rstrip())))
    return out


_CLUSTER = re.compile(rf"[.!?…{OWN_MARKS};；;]+(?:[ ]?[»”’」』】）)\]\"'“]+)?[.!?…]*")


_LEADING = re.compile("[" + re.escape(OPENERS + "\"'¿¡ -—–*•") + "]*")


def _prose(s: str, a: int, b: int, inner: list, ranges: list, lang: str, abbr: set, start: set, ordinal: set) -> Iterator[int]:
    caseless = lang in ("arab", "deva", "indic", "thai", "lao", "hani", "ja", "ko", "hy", "ethi", "mymr", "khmr", "he")
    opening = [x for x, _ in ranges]
    for m in _CLUSTER.finditer(s, a, b):
        x, y = m.start(), m.end()
        marks = m[0]
        # Marks that are part of a name do not end sentences; what follows them may.
        while x < y and any(p <= x < q for p, q in inner):
            x += 1
        if x == y:
            continue
        marks = s[x:y]
        core = marks.rstrip(CLOSERS + " ") or marks
        if core[0] in ";；;" and not (lang == "el" and core[0] in ";;"):
            continue
        if core[0] in CLOSERS:
            # Closing marks only, left over after a name: the name's mark ended nothing.
            continue
        # A quotation or bracket that is still open holds the sentence together.
        k = bisect_right(opening, x) - 1
        closes = False
        if k >= 0 and ranges[k][0] < x <= ranges[k][1]:
            if ranges[k][1] >= y:
                continue
            closes = True
        elif '"' in marks or "“" in marks:
            # A quote that opens here is no closing mark.
            for j in range(len(core), len(marks)):
                if any(r[0] == x + j for r in ranges):
                    y = x + j
                    marks = s[x:y].rstrip()
                    break
        own = any(c in OWN_MARKS for c in core)
        nxt = _BLANKS.match(s, y, b).end()
        blank = nxt - y
        if nxt == b:
            continue
        first = s[nxt]
        lead = _LEADING.match(s, nxt, b).end()
        word = (_TOKEN.match(s, lead, b) or [""])[0]
        kind = word_type(word) if word else ""
        upper = bool(word) and (word[0].isupper() or (not word[0].islower() and word[0].isalpha()))
        opener = first in OPENERS or first in "\"¿¡"
        if first in ",;:，；：、—–" or (first == "-" and s[nxt + 1 : min(nxt + 2, b)] == " "):
            continue
        if first in CLOSERS and not opener:
            continue
        if closes and own and not blank:
            continue  # scripts without blanks: the clause that carries the quotation goes on
        if own and not core.startswith("."):
            if lang in ("hani", "ja") or blank or upper or opener:
                yield nxt
            continue
        if word and word[0].islower() and not first.isdigit() and first not in "¿¡":
            continue
        if core[0] in "!?" or (len(core) > 1 and any(c in "!?" for c in core)):
            if upper or opener:
                yield nxt
            elif first.isdigit() and blank and not closes:
                yield nxt
            continue
        if core[0] in ";;":
            if upper or opener:
                yield nxt
            continue
        if "…" in core or core.startswith(".."):
            if upper or opener:
                yield nxt
            continue
        # One period.
        if closes:
            if (upper or opener or first.isdigit()) and blank or kind in start:
                yield nxt
            continue
        last = _LAST.match(s, a, x)
        before = last[0] if last else ""
        if not before:
            if x > a and s[x - 1] in CLOSERS + "+#%€$°²" and (upper or opener) and (blank or kind in start):
                yield nxt
            elif x > a and not s[x - 1].isspace() and blank and (upper or opener):
                yield nxt
            continue
        p = word_type(before)
        strong = "¿" in s[nxt:lead] or "¡" in s[nxt:lead]
        if not blank:
            # A missing blank after the period, or a name with a point inside.
            if upper and not first.isdigit() and len(word) > 1 and kind in start and p not in abbr and len(before) > 1:
                yield nxt
            continue
        if first.isdigit():
            if p not in abbr and p != "#" and len(before) > 5 and "." not in before:
                yield nxt
            continue
        if not (upper or opener):
            if not caseless and not word:
                continue
            if caseless and p not in abbr and len(before) > 1:
                yield nxt
            continue
        if strong or kind in start:
            # Capital initials stay with the name even if the name begins sentences too.
            if not (len(before) == 1 and before.isupper() and p not in abbr and not strong):
                yield nxt
            continue
        if p == "#":
            if kind not in ordinal:
                yield nxt
            continue
        if p in abbr or len(before) == 1 or ("." in before and len(max(before.split("."), key=len)) <= 2):
            continue
        yield nxt


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(SPAN)
def split_udf(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for text, starts, ends, lang, abbr, start, ordinal in batches:
        out = []
        for t, x, y, g, a, b, c in zip(text, starts, ends, lang, abbr, start, ordinal):
            spans = [(int(p), int(q)) for p, q in zip(x, y) if p == p and q == q and 0 <= p < q <= len(t)] if x is not None and y is not None else []
            as_set = lambda v: set(v) if v is not None else set()
            out.append([{"start": p, "end": q} for p, q in split(t, spans, g or "en", as_set(a), as_set(b), as_set(c))])
        yield pd.Series(out)


def sentences(rows: DataFrame) -> DataFrame:
    """(datum_id, sent_start, sent_end) for rows (id, text, entities)."""
    spans = F.transform(F.filter("entities", lambda e: e["start"] < e["end"]), lambda e: F.struct(e["start"].alias("a"), e["end"].alias("b")))
    texts = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text", F.array_sort(F.array_distinct(spans)).alias("spans")).distinct()
    texts = texts.select("*", F.xxhash64("id", "text", F.to_json(F.struct("spans"))).alias("row"))
    seen = texts.select("*", observe_udf("text").alias("o")).select("id", "text", "spans", "row", "o.lang", "o.words", "o.pairs")
    seen = stage(seen, "seen")
    learned, ordinal = learn(seen)
    learned = stage(learned, "learned")
    # To each text the learned words around its periods and marks.
    key = F.concat_ws("\n", "lang", "w").alias("key")
    has = seen.select("row", "lang", F.explode(F.array_distinct(F.transform("words", lambda w: w["w"]))).alias("w")).select("row", key)
    # Frequent words are in a large share of the texts; they meet the few learned rows of theirs by broadcast.
    own = lookup_join(has, learned.select(key, "w", "abbr", "start"), "key", "inner").groupBy("row").agg(
        F.collect_list(F.when(F.col("abbr"), F.col("w"))).alias("abbr"), F.collect_list(F.when(F.col("start"), F.col("w"))).alias("start")
    )
    nums = seen.select("row", "lang", F.inline("pairs")).where("w = '#' and kind = 'up'").join(ordinal, ["lang", "v"], "left_semi").groupBy("row").agg(F.collect_set("v").alias("ordinal"))
    ready = seen.select("id", "row", "text", "spans", "lang").join(own, "row", "left").join(nums, "row", "left")
    found = ready.select("id", F.explode(split_udf("text", F.col("spans.a"), F.col("spans.b"), "lang", "abbr", "start", "ordinal")).alias("s"))
    return found.select(F.col("id").alias("datum_id"), F.col("s.start").alias("sent_start"), F.col("s.end").alias("sent_end")).distinct()
