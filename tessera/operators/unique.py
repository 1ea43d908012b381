"""Unique-or-nothing resolution: a reference becomes an edge only where exactly one candidate is provable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_unique(references: DataFrame, candidates: DataFrame, on: list[str], target: str = "target") -> DataFrame:
    """references with n_targets, target (null unless there is exactly one) and status.

    candidates has the columns `on` and `target`. They are counted by key before the join, which so never
    multiplies rows: a name with very many candidates costs one row. Two distinct targets are all that it
    takes to tell, so minimum and maximum stand in for the set.
    """
    facts = candidates.groupBy(*on).agg(F.countDistinct(target).alias("n_targets"), F.min(target).alias("_only"))
    out = references.join(facts, on, "left").withColumn("n_targets", F.coalesce("n_targets", F.lit(0)).cast("long"))
    status = F.when(F.col("n_targets") == 0, "UNRESOLVED").when(F.col("n_targets") > 1, "AMBIGUOUS").otherwise("EDGE")
    return out.withColumn(target, F.when(F.col("n_targets") == 1, F.col("_only"))).withColumn("status", status).drop("_only")
