"""Tables written between the steps of a job, in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where the setting is absent and all runs on this machine, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return f"{named.rstrip('/')}/tessera-{app}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table that was written and is read back: its lineage ends here, and a lost executor costs a re-read."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL = 1 << 20


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside broadcast only what takes at most 1 MB on disk: compressed paths and names grow tenfold in the driver's memory."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > SMALL:
        spark.conf.set(key, str(SMALL))
    try:
        yield
    finally:
        spark.conf.set(key, before)
