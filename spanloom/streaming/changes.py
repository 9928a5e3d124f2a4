"""Changed documents as a stream: every micro-batch updates the document table and extracts from what changed.

Each micro-batch writes one snapshot of the store, in a folder named by its number. A batch that is delivered again
after a failure starts from the same snapshot and replaces its own, so results are those of one delivery.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators import documents, extract
from spanloom.operators.store import Store

TABLES = ("document", "keyword", "document_keyword")


def apply_changes(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """The document table after changes (rows of documents): the latest row of each id holds; what was last processed stays as it was."""
    done = docs.select("id", F.col("ner_text").alias("_done"))
    new = documents.current(changes.select(*docs.columns))
    kept = docs.join(new.select("id"), "id", "left_anti")
    moved = new.join(done, "id", "left").withColumn("ner_text", F.col("_done")).select(*docs.columns)
    return kept.unionByName(moved)


def read_snapshot(spark: SparkSession, folder: str, number: int) -> Store:
    return Store(*[spark.read.parquet(f"{folder}/{number}/{t}") for t in TABLES])


def write_snapshot(store: Store, folder: str, number: int) -> None:
    for name, df in zip(TABLES, (store.documents, store.keywords, store.links)):
        df.write.mode("overwrite").parquet(f"{folder}/{number}/{name}")


def extract_from_stream(
    changes: DataFrame, folder: str, checkpoint: str, as_of: Callable[[int], datetime], update: int = 1, load=None, available_now: bool = True
) -> StreamingQuery:
    """Start the query. Snapshot -1 in ``folder`` is where it begins; batch n makes snapshot n from snapshot n - 1."""

    def step(batch: DataFrame, number: int) -> None:
        was = read_snapshot(batch.sparkSession, folder, number - 1)
        now = Store(apply_changes(was.documents, batch), was.keywords, was.links)
        write_snapshot(extract.extract_documents(now, as_of(number), update, load=load), folder, number)

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
