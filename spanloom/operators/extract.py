"""Finding keywords in texts with a pluggable model, and saving what is found.

A model is a function from sentences to tags. It is loaded once per Python worker and called with batches of
documents. Without one, a dictionary tagger in plain expressions finds known keywords.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import CUT, pieces
from spanloom.operators import documents, sentences, spans
from spanloom.operators.store import Store, save, saved_data
from spanloom.plans.skew import lookup_join
from spanloom.schemas import EXTRACTED, SPANS
from spanloom.session import stage

#: A tagger gets the tokens of a document's sentences and gives a tag for each token.
Tagger = Callable[[list[list[str]]], list[list[str]]]


@cache
def _loaded(load: Callable[[], Tagger]) -> Tagger:
    return load()


def tag_with(load: Callable[[], Tagger]):
    """A function column: tags for array<array<string>> tokens, by the tagger that ``load`` gives, loaded once a worker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = _loaded(load)
        for docs in batches:
            yield pd.Series([[list(t) for t in tagger([list(s) for s in doc])] if doc is not None and len(doc) else [] for doc in docs])

    return F.pandas_udf(run, "array<array<string>>")


def tokenized(text: Column) -> Column:
    """Tokens of each sentence: array<array<struct<token, offset>>>."""
    return F.transform(sentences.extract_sentences(text), lambda s: spans.tokens_of(s))


def extract(texts: DataFrame, load: Callable[[], Tagger], with_bio: bool = True) -> DataFrame:
    """(id, text, entities, status) for (id, text): sentences, tokens, the model's tags, spans; every keyword found is extracted.

    Tags beyond the tokens, and tokens beyond the tags, are left out. A null text, and one without sentences, has nothing.
    """
    tok = texts.select("id", "text", tokenized(F.col("text")).alias("_tok"))
    words = F.transform("_tok", lambda s: F.transform(s, lambda t: t["token"]))
    # Written once, so that a model runs once however often its result is read.
    tagged = stage(tok.withColumn("_tags", tag_with(load)(words)), "tagged")

    def decode(z: Column) -> Column:
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
        s, tags = none(z["_tok"], "array<struct<token:string,offset:int>>"), none(z["_tags"], "array<string>")
        zipped = F.transform(
            F.slice(s, F.lit(1), F.least(F.size(s), F.size(tags))), lambda t, j: F.struct(t["token"].alias("token"), F.get(tags, j).alias("tag"), t["offset"].alias("offset"))
        )
        return spans.decode_tags(zipped, with_bio)

    found = F.coalesce(F.flatten(F.transform(F.arrays_zip("_tok", "_tags"), decode)), F.array().cast(SPANS))
    return _as_extracted(tagged.select("id", "text", found.alias("entities")))


def _as_extracted(found: DataFrame) -> DataFrame:
    keys = F.array_distinct(F.transform("entities", lambda e: spans.value_of(F.col("text"), e)))
    return found.withColumn("status", F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(EXTRACTED).alias("value")))))


#: Characters of a dictionary up to which it is sent to every worker.
SENT = 20_000_000
#: Rows of a filter sent to every worker, as a power of two. A fuller filter lets more runs pass that are no keywords.
BUCKETS = 21


def _parts(text: Column) -> Column:
    """Gaps and tokens by turns, gaps first and last; they may be empty, tokens are not."""
    return pieces(text, spans.TOKEN)


def _as_part(low: Column) -> Column:
    """Lower case as it is in a part of the text too: whether a sigma is written as a final one hangs on what follows it."""
    return F.replace(low, F.lit("ς"), F.lit("σ"))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << BUCKETS) - 1))


def _bit(at: Column) -> Column:
    """A long with one bit set; of ``at`` the lowest six bits count."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _length_bit(h: Column, n: Column) -> Column:
    return _bit(F.shiftright(h, BUCKETS).bitwiseAND(F.lit(63)) + n)


def _value_bits(h: Column) -> Column:
    one, *more = [_bit(F.shiftright(h, BUCKETS + k).bitwiseAND(F.lit(63))) for k in (0, 6, 12)]
    for bit in more:
        one = one.bitwiseOR(bit)
    return one


def _filter(hashed: DataFrame, bits: Column) -> DataFrame:
    """(bucket, bits) for (h, ...): what may pass, at most 2 ** BUCKETS rows of two longs however many keywords there are."""
    return F.broadcast(hashed.groupBy(_bucket(F.col("h")).alias("bucket")).agg(F.bit_or(bits).alias("bits")))


def _run() -> Column:
    return F.array_join(F.slice("sent", F.col("i") + 1, 2 * F.col("number") - 1), "")


def _place() -> list[Column]:
    start = F.col("at") + F.length(F.array_join(F.slice("sent", F.lit(1), F.col("i")), ""))
    return [start.alias("start"), (start + F.length(_run())).alias("end")]


def _runs(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, value, at, sent, i, number): runs that begin with the first token of a keyword of as many tokens, and few others.

    A run has ``number`` tokens from part ``i`` of its sentence's parts ``sent`` on; the sentence is ``at`` in the text.
    """
    n = lambda v: F.shiftright(F.size(_parts(v)), 1)
    # Lower case makes two tokens of the one letter İ; such a value may stand for a run of fewer tokens.
    sizes = F.sequence(n(F.regexp_replace("value", "i\u0307", "İ")), n(F.col("value")))
    first = F.xxhash64(_as_part(F.lower(F.get(_parts(F.col("value")), F.lit(1)))))
    known = keywords.where(F.col("value").isNotNull()).select(first.alias("h"), F.explode(sizes).alias("n")).where("n > 0")
    begin = _filter(known, _length_bit(F.col("h"), F.col("n")))
    lengths = known.agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    # Plain columns and no lambda functions from here on: tokens are met in compiled code, and only runs that pass are built.
    sents = texts.select("id", F.explode(sentences.extract_sentences(F.col("text"))).alias("s")).select("id", F.col("s.offset").alias("at"), F.col("s.text").alias("text"))
    sents = sents.crossJoin(F.broadcast(lengths)).select("id", "at", _parts(F.col("text")).alias("sent"), "lengths")
    low = F.split(_as_part(F.lower(F.array_join("sent", CUT))), CUT, -1)
    one = sents.select("id", "at", "sent", "lengths", F.posexplode(low).alias("i", "token")).where("i % 2 = 1").withColumn("h", F.xxhash64("token"))
    one = one.withColumn("bucket", _bucket(F.col("h"))).join(begin, "bucket").select("id", "at", "sent", "i", "h", "bits", F.explode("lengths").alias("number"))
    runs = one.where((F.col("i") + 2 * F.col("number") <= F.size("sent")) & (F.col("bits").bitwiseAND(_length_bit(F.col("h"), F.col("number"))) != 0))
    # Never null; said so, as else a filter on it would build it once more.
    value = F.coalesce(F.lower(_run()), F.lit(""))
    return runs.select("id", value.alias("value"), "at", "sent", "i", "number")


def _met(runs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, start, end, class): runs that are in the dictionary. A dictionary of a checked size is sent to the runs, which then are not
    shuffled; of a larger one a filter is sent, and the runs that pass are written once and met by value, frequent ones (keyword or
    not) apart from the others."""
    size = dictionary.agg(F.sum(F.length("value") + F.coalesce(F.length("class"), F.lit(0)) + 16)).collect()[0][0] or 0
    if size <= SENT:
        return runs.join(F.broadcast(dictionary), "value").select("id", *_place(), "class")
    known = _filter(dictionary.select(F.xxhash64("value").alias("h")), _value_bits(F.col("h")))
    hashed = runs.withColumn("h", F.xxhash64("value")).withColumn("bucket", _bucket(F.col("h"))).join(known, "bucket")
    passed = hashed.where(F.col("bits").bitwiseAND(_value_bits(F.col("h"))) == _value_bits(F.col("h")))
    return lookup_join(stage(passed.select("id", "value", *_place()), "runs"), dictionary, "value", "inner").select("id", "start", "end", "class")


def found_by_dictionary(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, entities) for (id, text): known keywords of any number of tokens, longest first, without overlap; texts without any are left out.

    Runs of as many tokens as some keyword of the same first token meet the keyword table in an equi-join on the exact stored value, so
    the work grows with the texts, not with texts times keywords. What is shuffled are runs equal to a keyword and, where the dictionary is
    large, a few that a filter by hash lets pass, never all runs. A run is cut from its sentence: from the document each cut would count
    characters from the document's start.
    """
    dictionary = keywords.where(F.col("value").isNotNull()).groupBy("value").agg(F.min_by("type", "id").alias("class"))
    hits = _met(_runs(texts, keywords), dictionary)
    per = hits.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("back"), "class"))).alias("h"))
    taken = F.aggregate(
        "h",
        F.array().cast(SPANS),
        lambda out, x: F.when(
            x["start"] >= F.coalesce(F.try_element_at(out, F.lit(-1))["end"], F.lit(0)), F.concat(out, F.array(spans.span(x["start"], -x["back"], x["class"])))
        ).otherwise(out),
    )
    return per.select("id", taken.alias("entities"))


def extract_by_dictionary(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, text, entities, status) for (id, text): the spans of ``found_by_dictionary``, none for a text without a keyword."""
    out = texts.select("id", "text").join(found_by_dictionary(texts, keywords), "id", "left")
    return _as_extracted(out.withColumn("entities", F.coalesce("entities", F.array().cast(SPANS))))


def merge_with_saved(found: DataFrame, store: Store, carry_status: bool = False) -> DataFrame:
    """(id, text, entities, status): found spans merged with the saved ones; saved spans of another text are looked up again.

    One join for all documents.
    """
    saved = saved_data(store).select("id", F.col("text").alias("_t"), F.col("entities").alias("_e"), F.col("status").alias("_s"))
    met = found.join(saved, "id", "left")
    same = F.col("_t").eqNullSafe(F.col("text")) | F.col("_t").isNull()
    cols = ["id", "text", "entities", "status", "saved_entities", "saved_status"]
    kept = met.where(same).withColumnsRenamed({"_e": "saved_entities", "_s": "saved_status"}).select(*cols)
    moved = met.where(~same).select(
        "id", F.col("entities").alias("_new"), F.col("status").alias("_new_status"), F.col("_t").alias("text"), F.col("_e").alias("entities"), F.col("_s").alias("status"), F.col("text").alias("new_text")
    )
    moved = spans.reanchor(moved).withColumnsRenamed({"entities": "saved_entities", "status": "saved_status"}).withColumnsRenamed({"_new": "entities", "_new_status": "status"})
    return spans.merge(kept.unionByName(moved.select(*cols)), carry_status).select("id", "text", "entities", "status")


def extract_documents(
    store: Store, as_of: datetime, update: int = 1, kind: str | None = None, load: Callable[[], Tagger] | None = None, needle: int | str | None = None
) -> Store:
    """The store after extracting from the documents that need it: of a type, or the one a needle names.

    A needle is not held back by activity, duplicates or a missing text; a missing text gives nothing.
    """
    docs = store.documents
    todo = documents.worklist(docs, update, kind) if needle is None else documents.by_needle(docs, needle).where(documents.needs_update(update))
    texts = todo.select("id", F.coalesce("text", F.lit("")).alias("text"))
    found = extract(texts, load) if load else stage(extract_by_dictionary(texts, store.keywords), "found")
    # Written once: the three tables of the result read it several times.
    return save(store, stage(merge_with_saved(found, store), "merged"), as_of)
