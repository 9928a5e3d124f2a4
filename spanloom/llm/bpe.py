"""Problem 7: encoding of texts with a public byte-level BPE vocabulary.

Each partition splits its texts into words, and the distinct words that are no token as they stand
are merged by a recursive query in an embedded DuckDB: rows of token positions join the merge table, the
leftmost pair of minimum rank of each word is contracted, until no pair is left. Words repeat, so each
is merged once a partition.

Cases: an empty and a null text both give an empty list. White space alone is text and has ids.
Strings that look like control tokens are ordinary text. A word longer than ``LONG_WORD`` bytes would
take the recursion as many rounds as it has merges; it is merged by a heap with the same result.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabulary files lie; never copied into the repository.
TOKENIZERS = os.environ.get("SPANLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"

# Fixed value: the published word pattern of this vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LONG_WORD = 256
#: Distinct words remembered by a partition; beyond it the memory starts anew, with the same result.
REMEMBERED = 500_000

CONTRACT = """
with recursive s(wid, pos, tok, live) as (
    select wid, pos, tok, true from start
    union all
    select wid, pos, case when pos = spot then made else tok end, best is not null
    from (
        select *, min(case when rank = best then pos end) over (partition by wid) as spot
        from (
            select a.*, m.rank, m.made, min(m.rank) over (partition by a.wid) as best
            from (
                select wid, pos, tok,
                    lead(tok) over (partition by wid order by pos) as following,
                    lag(pos) over (partition by wid order by pos) as before
                from s where live
            ) a left join merges m on m.l = a.tok and m.r = a.following
        )
    ) where spot is null or before is distinct from spot
)
select wid, list(tok order by pos) as ids from s where not live group by wid
"""


def _byte_letters() -> dict[str, int]:
    """Letter to byte as byte-level vocabularies write bytes: printable bytes as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = _byte_letters()
        as_bytes = lambda t: bytes(letters[c] for c in t)
        vocab = {t: i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.id_of = {as_bytes(t): i for t, i in vocab.items() if t not in ("<|endoftext|>",)}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.byte_id = np.array([self.id_of[bytes([b])] for b in range(256)], np.int32)

    def merge_table(self) -> pa.Table:
        l, r = zip(*self.merges)
        rank, made = zip(*self.merges.values())
        return pa.table({n: pa.array(v, pa.int32()) for n, v in (("l", l), ("r", r), ("rank", rank), ("made", made))})

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges for one long word, with a heap over its neighbouring pairs."""
        tok = [int(self.byte_id[b]) for b in word]
        after, before = [*range(1, len(tok)), -1], [-1, *range(len(tok) - 1)]
        alive = [True] * len(tok)
        pair = lambda i: self.merges.get((tok[i], tok[after[i]])) if after[i] >= 0 else None
        heap = [(p[0], i) for i in range(len(tok)) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or not (p := pair(i)) or p[0] != rank:
                continue
            j = after[i]
            tok[i], alive[j], after[i] = p[1], False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (q := pair(k)):
                    heapq.heappush(heap, (q[0], k))
        return [t for t, a in zip(tok, alive) if a]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def _pattern():
    import regex

    return regex.compile(WORD_PATTERN)


class Encoder:
    """Encodes texts; remembers the ids of words as bytes of 32-bit integers."""

    def __init__(self, path: str) -> None:
        import duckdb

        self.vocab = vocabulary(path)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})
        self.db.register("merge_table", self.vocab.merge_table())
        self.db.execute("create table merges as select * from merge_table")
        self.known: dict[str, bytes] = {}
        self.spelled = False

    def learn(self, words: Iterable[str]) -> None:
        pack = lambda ids: np.asarray(ids, np.int32).tobytes()
        hard: list[str] = []
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            # Every token is reached by merging its own bytes (a test holds this), so a word that is a token stays whole.
            if (i := self.vocab.id_of.get(b)) is not None:
                self.known[w] = pack([i])
            elif len(b) > LONG_WORD:
                self.known[w] = pack(self.vocab.merge_long(b))
            else:
                hard.append(w)
        for at in range(0, len(hard), 20_000):
            part = hard[at : at + 20_000]
            raw = [w.encode("utf-8", "surrogatepass") for w in part]
            n = np.fromiter(map(len, raw), np.int64, len(raw))
            ends = np.cumsum(n)
            start = pa.table(
                {
                    "wid": np.repeat(np.arange(len(raw), dtype=np.int32), n),
                    "pos": (np.arange(ends[-1]) - np.repeat(ends - n, n)).astype(np.int32),
                    "tok": self.vocab.byte_id[np.frombuffer(b"".join(raw), np.uint8)],
                }
            )
            self.db.register("start", start)
            got = self.db.sql(CONTRACT).to_arrow_table().combine_chunks()
            self.db.unregister("start")
            ids = pa.concat_arrays(got.column("ids").chunks)
            flat, bounds = np.asarray(ids.values, np.int32), np.asarray(ids.offsets)
            for k, wid in enumerate(got.column("wid").to_pylist()):
                self.known[part[wid]] = flat[bounds[k] : bounds[k + 1]].tobytes()

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        find = _pattern().findall
        words = [find(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn({w for ws in words for w in ws}.difference(self.known))
        parts = [b"".join(map(self.known.__getitem__, ws)) for ws in words]
        offsets = np.zeros(len(parts) + 1, np.int32)
        np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))

    def lengths(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text, without listing them."""
        find = _pattern().findall
        words = [find(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn({w for ws in words for w in ws}.difference(self.known))
        known = self.known.__getitem__
        return [sum(map(len, map(known, ws))) // 4 for ws in words]

    def decode(self, lists: pa.ListArray) -> list[str]:
        """The text of each list of ids: an ordered aggregation of the bytes of its tokens."""
        if not self.spelled:
            pieces = pa.table({"tok": pa.array(self.vocab.bytes_of, pa.int32()), "spelling": pa.array([b.hex() for b in self.vocab.bytes_of.values()])})
            self.db.register("piece_table", pieces)
            self.db.execute("create table pieces as select * from piece_table")
            self.spelled = True
        n = np.diff(np.asarray(lists.offsets))
        rows = pa.table({"doc": np.repeat(np.arange(len(n)), n), "pos": np.arange(int(n.sum())), "tok": lists.flatten()})
        self.db.register("tokens", rows)
        got = dict(self.db.sql("select doc, string_agg(spelling, '' order by pos) from tokens join pieces using (tok) group by doc").fetchall())
        self.db.unregister("tokens")
        return [bytes.fromhex(got.get(i, "")).decode("utf-8", "replace") for i in range(len(n))]


def encode_texts(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) for every row; no shuffle, columns other than the two are not read."""
    path = path or f"{TOKENIZERS}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), enc.encode(part.column(1).to_pylist())], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens) for every row."""
    path = path or f"{TOKENIZERS}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(enc.lengths(b.column(1).to_pylist()), pa.int64())], names=["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens long")


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, same): whether decoding the ids gives the text again."""
    path = path or f"{TOKENIZERS}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = enc.encode(texts)
            same = [back == (t or "") for back, t in zip(enc.decode(ids), texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(np.asarray(ids.offsets)), pa.int32()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "same"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens int, same boolean")
