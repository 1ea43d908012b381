"""Keeping facts current from a stream of changed files.

A feed has rows path, lang, content, deleted. Every micro-batch replaces the rows of its paths in the facts
table: the last row of a path in the batch counts. The new table is written beside the old one and becomes
current by the batch number, so a batch that is run again after a failure gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.facts import SCHEMA
from ..sources import tree
from .incremental import refresh_rows

FEED = "path string, lang string, content string, deleted boolean, at timestamp"


def facts_after(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """The facts as of a batch; before the first there are none."""
    return spark.read.parquet(f"{folder}/batch={batch}") if batch >= 0 else spark.createDataFrame([], SCHEMA)


def apply_batch(facts: DataFrame, rows: DataFrame) -> DataFrame:
    last = rows.groupBy("path").agg(F.max_by(F.struct("lang", "content", "deleted"), "at").alias("r")).select("path", "r.*")
    fresh = tree.facts_of(last.where("not deleted and lang is not null"))
    return refresh_rows(facts, last.select("path"), fresh.select(*facts.columns))


def keep_facts(feed: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start a query that writes folder/batch=N for every micro-batch of the feed."""

    def each(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        apply_batch(facts_after(spark, folder, batch - 1), rows).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
