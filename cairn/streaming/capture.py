"""Captured pages as a stream of events: the last capture of a page wins, unchanged ones are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import store
from cairn.sources.snapshots import SnapshotTable


def upsert_pages(target: SnapshotTable, least_chars: int = 80, most_chars: int = 50_000):
    """A ``foreachBatch`` function: (uri, text, captured_at) rows are cut, short ones dropped, and merged into a snapshot table, once per batch id."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        pages = batch.select("uri", F.substring("text", 1, most_chars).alias("text"), "captured_at").where(F.length("text") >= least_chars)
        pages = store.latest(pages.withColumn("content_hash", F.sha1("text")), ["uri"], "captured_at")
        stored = target.read()
        if stored is None:
            target.publish(pages, token=f"batch-{batch_id}")
            return
        changed = pages.join(stored.select("uri", F.col("content_hash").alias("was")), "uri", "left").where(F.col("was").isNull() | (F.col("was") != F.col("content_hash"))).drop("was")
        target.publish(store.replace_by_key(stored, changed, "uri"), token=f"batch-{batch_id}")

    return merge
