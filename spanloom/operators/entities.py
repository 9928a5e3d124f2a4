"""The chain that prepares labelled texts (id, text, entities) for training.

Each step keeps offsets right. All steps work inside the row, but for the majority class, which counts over the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators import punctuation, sentences, spans
from spanloom.plans.skew import lookup_join
from spanloom.session import stage


def majority_class(data: DataFrame, order: str = "id") -> DataFrame:
    """(token, class): the most frequent class of each keyword over all spans; of ties the class seen first.

    Spans are counted with partial aggregation; ``order`` and the place in the row say which is first.
    """
    seen = data.select(order, "text", F.posexplode(spans.spans_or_none(F.col("entities"))).alias("pos", "e")).select(
        spans.value_of(F.col("text"), F.col("e")).alias("token"), F.col("e.class").alias("class"), F.struct(order, "pos").alias("at")
    )
    counts = seen.groupBy("token", "class").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    rank = Window.partitionBy("token").orderBy(F.desc("n"), "first")
    return counts.withColumn("k", F.row_number().over(rank)).where("k = 1").select("token", "class")


def with_majority_class(data: DataFrame, order: str = "id") -> DataFrame:
    """Every span with the majority class of its keyword."""
    return with_class_of(data, majority_class(data, order), order)


def with_class_of(data: DataFrame, classes: DataFrame, order: str = "id") -> DataFrame:
    """Every span with the class that ``classes`` (token, class; tokens unique) has for its keyword; others keep theirs.

    Rows meet only the classes of their own keywords. A row is known by its key and text, so rows that are equal in both share one
    list of classes, and a repeated task finds the same rows.
    """
    row = data.withColumn("_row", F.xxhash64(order, "text"))
    values = F.array_distinct(F.transform(spans.spans_or_none(F.col("entities")), lambda e: spans.value_of(F.col("text"), e)))
    own = (
        lookup_join(row.select("_row", F.explode(values).alias("token")).distinct(), classes.select("token", "class"), "token", "inner")
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "class"))).alias("_class"))
    )
    new = F.transform(
        F.col("entities"),
        lambda e: spans.span(e["start"], e["end"], F.coalesce(F.try_element_at("_class", spans.value_of(F.col("text"), e)), e["class"])),
    )
    return lookup_join(row, own, "_row").withColumn("entities", new).drop("_row", "_class")


def preprocess(data: DataFrame, languages: list[str] = (), lemmas: dict[str, str] | None = None, order: str = "id") -> DataFrame:
    """All steps in order: join C++, cut lists, trim both ends, cast letters, classes by dictionary and majority, drop
    empty spans, space marks, rebuild sentences."""
    known = F.create_map(*[F.lit(x) for kv in lemmas.items() for x in kv]) if lemmas else None
    names = F.array(*[F.lit(x) for x in languages]).cast("array<string>")
    prepared = spans.chain(
        {"t": spans.join_plus(F.col("text")), "e": spans.spans_or_none(F.col("entities"))},
        [
            lambda s: {"e": punctuation.split_spans(s["t"], s["e"])},
            lambda s: {"e": F.transform(s["e"], lambda e: spans.trim_span_start(s["t"], e, known))},
            lambda s: {"e": F.transform(s["e"], lambda e: punctuation.trim_span_end(s["t"], e))},
            lambda s: {"t": spans.cast_tokens(s["t"], s["e"])},
            lambda s: {"e": spans.override_class(s["t"], s["e"], names, "ProgLanguage")},
        ],
        lambda s: F.struct(s["t"].alias("text"), s["e"].alias("entities")),
    )
    data = data.where(F.col("text").isNotNull()).withColumn("_p", prepared)
    data = data.withColumn("text", F.col("_p.text")).withColumn("entities", F.col("_p.entities")).drop("_p")
    # Written once: the majority reads the texts twice.
    data = with_majority_class(stage(data, "prepared"), order)
    return rebuild(stage(space_marks(data.withColumn("entities", spans.non_empty(F.col("entities")))), "spaced"))


def space_marks(data: DataFrame) -> DataFrame:
    """Marks spaced, spans moved along."""
    parts = data.withColumn("_parts", punctuation.spaced_pieces(F.col("text")))
    return (
        parts.withColumn("entities", punctuation.move_spans(F.col("_parts"), F.col("entities")))
        .withColumn("text", punctuation.text_of(F.col("_parts")))
        .drop("_parts")
    )


def rebuild(data: DataFrame, add_empty: bool = True) -> DataFrame:
    """The text put together anew from its sentences, spans moved along."""
    s = sentences.attach_entities(sentences.extract_sentences(F.col("text"), F.col("entities")), F.col("entities"), add_empty)
    return data.withColumn("_new", sentences.rebuild_sentences(s)).withColumn("text", F.col("_new.text")).withColumn("entities", F.col("_new.entities")).drop("_new")
