"""Labelled texts for a sequence tagger: reading them without repeats, token rows, a baseline tagger, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators import sentences, spans


def record_id(kind: Column, own: Column, meta_id: Column) -> Column:
    """``kind-id``; of the kind rpd the id inside meta, or ``unk-id`` without one."""
    number = F.when(kind == "rpd", F.coalesce(meta_id, F.concat(F.lit("unk-"), own))).otherwise(own)
    return F.concat(kind, F.lit("-"), number)


def last_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, with ``_first``: the order of the key's first row."""
    at = F.struct(*order)
    w = Window.partitionBy(key)
    return (
        rows.withColumn("_first", F.min(at).over(w))
        .withColumn("_k", F.row_number().over(w.orderBy(*[F.desc(c) for c in order])))
        .where("_k = 1")
        .drop("_k")
    )


def of_kinds(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Rows of the kinds; all rows when no kind is given."""
    return rows.where(F.col("kind").isin(list(kinds))) if kinds else rows


def sentence_rows(data: DataFrame, add_empty: bool = False, with_bio: bool = True, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep..., sentence, tokens): one row per sentence, tokens as array<struct<token, tag, offset>>."""
    attached = sentences.attach_entities(sentences.extract_sentences(F.col("text"), F.col("entities")), spans.spans_or_none(F.col("entities")), add_empty)
    rows = data.where(F.col("text").isNotNull()).select(*keep, F.posexplode(attached).alias("sentence", "s"))
    return rows.select(*keep, "sentence", spans.tag_tokens(spans.tokens_of(F.col("s")), F.col("s.entities"), with_bio).alias("tokens"))


def labels_of(data: DataFrame) -> DataFrame:
    """(id, labels, tokens): for each text the plain tags and tokens of all its sentences."""
    attached = sentences.attach_entities(sentences.extract_sentences(F.col("text")), spans.spans_or_none(F.col("entities")), True)
    tagged = F.transform(attached, lambda s: spans.tag_tokens(spans.tokens_of(s), s["entities"], False))
    rows = data.where(F.col("text").isNotNull()).withColumn("_t", tagged)
    return rows.select(
        "id",
        F.transform("_t", lambda s: F.transform(s, lambda t: t["tag"])).alias("labels"),
        F.transform("_t", lambda s: F.transform(s, lambda t: t["token"])).alias("tokens"),
    )


def token_rows(rows: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep..., sentence, pos, word, label): sentence rows by token."""
    return rows.select(*keep, "sentence", F.posexplode("tokens").alias("pos", "t")).select(*keep, "sentence", "pos", F.col("t.token").alias("word"), F.col("t.tag").alias("label"))


def prepare_training(data: DataFrame, kinds: list[str] = (), keep: tuple[str, ...] = ("id", "kind")) -> DataFrame:
    """Token rows of the sentences with spans, of the kinds asked for."""
    return token_rows(sentence_rows(of_kinds(data, list(kinds)), keep=keep), keep)


def majority_tags(tokens: DataFrame) -> DataFrame:
    """(word, label): the most frequent label of each word (of ties the smallest): a baseline tagger."""
    counts = tokens.groupBy(F.lower("word").alias("word"), "label").count()
    return counts.groupBy("word").agg(F.min_by("label", F.struct((-F.col("count")).alias("n"), "label")).alias("label"))


def evaluate(tokens: DataFrame, by: str = "kind", truth: str = "label", guess: str = "guess") -> DataFrame:
    """(by, precision, recall, f1, n) of labels other than O, for each kind."""
    hit = (F.col(truth) == F.col(guess)) & (F.col(truth) != "O")
    out = tokens.groupBy(by).agg(
        F.count_if(hit).alias("hits"), F.count_if(F.col(guess) != "O").alias("guessed"), F.count_if(F.col(truth) != "O").alias("true"), F.count("*").alias("n")
    )
    p, r = F.try_divide("hits", "guessed"), F.try_divide("hits", "true")
    return out.select(by, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"), "n")

