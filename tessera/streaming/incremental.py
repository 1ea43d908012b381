"""Keeping tables current: which paths changed between two snapshots, and rows replaced for just those."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, modified, deleted) from two snapshots (path, sha); one full join, no text."""
    a = before.select("path", F.col("sha").alias("_old"), F.lit(True).alias("_was"))
    b = after.select("path", F.col("sha").alias("_new"), F.lit(True).alias("_is"))
    both = a.join(b, "path", "full")
    change = F.when(F.col("_is").isNull(), "deleted").when(F.col("_was").isNull(), "added").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def same_files(before: DataFrame, after: DataFrame) -> bool:
    """Whether both snapshots have the same paths."""
    return before.select("path").exceptAll(after.select("path")).isEmpty() and after.select("path").exceptAll(before.select("path")).isEmpty()


def refresh_rows(rows: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """rows (with path) without those of changed paths, and the fresh rows of these."""
    return rows.join(changes.select("path"), "path", "left_anti").unionByName(fresh)
