"""Labelled texts as lines of JSON, and word lists.

Spans are arrays of mixed kinds, ``[0, 3, "X"]``, which no JSON reader types as a struct: they are read as arrays of strings and cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.training import last_of_each, record_id
from spanloom.schemas import SPANS

_LINE = "id string, kind string, text string, entities array<array<string>>, status map<string,string>, meta struct<id string>"


def spans_of(raw: Column) -> Column:
    return F.transform(raw, lambda e: F.struct(F.get(e, 0).cast("int").alias("start"), F.get(e, 1).cast("int").alias("end"), F.get(e, 2).alias("class")))


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, kind, text, entities, status, meta). A line that is no JSON raises; blank lines are skipped."""
    rows = spark.read.schema(_LINE).option("mode", "FAILFAST").json(path)
    return rows.withColumn("entities", spans_of(F.col("entities")))


def json_line(df: DataFrame) -> Column:
    """The row as JSON text, null fields included, spans as ``[start, end, "class"]``."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    fields = []
    for name in df.columns:
        if name == "entities":
            one = F.transform(name, lambda e: F.concat(F.lit("["), e["start"].cast("string"), F.lit(", "), e["end"].cast("string"), F.lit(", "), F.coalesce(quoted(e["class"]), F.lit("null")), F.lit("]")))
            value = F.coalesce(F.concat(F.lit("["), F.array_join(one, ", "), F.lit("]")), F.lit("null"))
        else:
            whole = F.to_json(F.struct(F.col(name).alias("v")), {"ignoreNullFields": "false"})
            value = F.substring(whole, F.lit(6), F.length(whole) - 6)
        fields.append(F.concat(F.lit(f'"{name}": '), value))
    return F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One line of UTF-8 JSON per row."""
    df.select(json_line(df).alias("value")).write.mode(mode).text(path)


def read_training(spark: SparkSession, files: list[str]) -> DataFrame:
    """Records of several files, each id once: the last record holds, in the place of the first.

    Later files override earlier ones; inside a file later lines override. ``file_no`` is the place in the list given. Of a
    folder of part files the order is that of their paths. A line that is no JSON raises.
    """
    lines = None
    for i, f in enumerate(files):
        # The id increases along each block of a file, which one task reads from its start.
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
        raw = spark.read.text(f).select(F.lit(i).alias("file_no"), place.alias("line_no"), F.col("value"))
        lines = raw if lines is None else lines.unionByName(raw)
    rows = lines.where(F.trim("value") != "").select("file_no", "line_no", F.from_json("value", _LINE, {"mode": "FAILFAST"}).alias("r"))
    rows = rows.select("file_no", "line_no", "r.*").withColumn("entities", spans_of(F.col("entities")))
    rows = rows.withColumn("id", record_id(F.col("kind"), F.col("id"), F.col("meta.id")))
    return last_of_each(rows, "id", ["file_no", "line_no"])


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): lines of a word list, trimmed, each once."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def health(spark: SparkSession, checks: dict[str, bool]) -> DataFrame:
    """(component, status) of named checks."""
    return spark.createDataFrame([(k, "ok" if v else "failed") for k, v in sorted(checks.items())], "component string, status string")


def health_counts(components: DataFrame) -> DataFrame:
    """(ok, failed, total)."""
    return components.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"), F.count("*").alias("total"))
