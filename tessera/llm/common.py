"""What the operators of this subpackage share: written tables, ordered ranks, connected components.

Intermediate tables go to the folder that the session names in spark.checkpoint.dir, which all
executors share; a lost executor then costs a re-read, never a recomputation that might differ.
"""

from __future__ import annotations

import threading
import weakref
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import new_path as _new_path

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return _new_path(spark, tag)


# While tables are written: texts are long, so Arrow batches are small and bounded in bytes, and the shuffle
# files of a write go as soon as it is done, not when the driver happens to collect garbage.
_WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
MOST_WORDS = 20  # a sieve has at most 2 to this power words of 64 bits
_lock = threading.Lock()
_open: dict[str, list] = {}
_passing = threading.local()


@contextmanager
def _settings(spark: SparkSession):
    """Settings of a write, taken back after the last of the session's writes that overlap; what the user set stays."""
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        held = _open.setdefault(session, [0, {}])
        held[0] += 1
        if held[0] == 1:
            for k, v in _WRITING.items():
                before = spark.conf.get(k, None)
                if not (k.endswith("maxRecordsPerBatch") and before not in (None, "10000")):
                    held[1][k] = before
                    spark.conf.set(k, v)
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                for k, v in _open.pop(session)[1].items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: ends the lineage, fixes row placement."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with _settings(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    for held in getattr(_passing, "held", [])[-1:]:
        held.append(out)
    return out


@contextmanager
def passing(spark: SparkSession):
    """The tables that cut() makes inside are deleted at the end, but for those given to the function that this yields."""
    stack = _passing.__dict__.setdefault("held", [])
    kept: list[DataFrame] = []
    stack.append([])
    try:
        yield lambda table: kept.append(table) or table
    finally:
        held = stack.pop()
        if stack:
            stack[-1] += kept
        release(spark, *(t for t in held if t in _paths and not any(t is k for k in kept)))


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing needs any more."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(_paths.pop(t))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores before those that are taken (whatever their case)."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def exactly(name: str) -> Column:
    """The column of that name, dots and back-ticks in it included."""
    return F.col(f"`{name.replace('`', '``')}`")


def sieve(keys: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """(word, bits) of a bit map with a bit set for each value of the only column, a long, and how many words it has.

    For sifted(): 32 bits a key, and 64 MBit at most, so that every task can hold it; more keys only sift less.
    """
    key = F.col(keys.columns[0])
    words = 1 << min(MOST_WORDS, max(4, (keys.count() // 2).bit_length()))
    bits = keys.groupBy(F.pmod(key, F.lit(words)).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{keys.columns[0]}`, 58) as int))")).alias("bits"))
    return cut(bits, tag), words


def sifted(table: DataFrame, key: Column, bits: tuple[DataFrame, int], name: str) -> DataFrame:
    """Add name: false where the key is surely not among the sieve's, without moving a row; key isn't null."""
    of, words = bits
    word, held, own = free_names([*table.columns, name], "sieve_word", "sieve_bits", "sieve_key")
    of = F.broadcast(of.select(F.col("word").alias(word), F.col("bits").alias(held)))
    both = table.withColumn(own, key).join(of, F.pmod(F.col(own), F.lit(words)) == F.col(word), "left")
    hit = F.expr(f"coalesce(`{held}` & shiftleft(1L, cast(shiftrightunsigned(`{own}`, 58) as int)), 0L) <> 0")
    return both.withColumn(name, hit).drop(word, held, own)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def ordered_offsets(df: DataFrame, order: list, group: list[str], value: str, out: str, tag: str, facts: DataFrame | None = None) -> DataFrame:
    """Add out: the sum of value over the rows of the same group that come earlier in the order.

    Rows are range-partitioned by (group, order), so a hot group spreads over many tasks; sums inside a
    partition and the (few) totals by partition and group are added up. The table is written once between
    the two so that the partition of a row is a fact, not something recomputed. The order must be total, but
    for rows that are equal in every column; these are told apart by a number of their own, so that any number
    of them spreads as well. facts, one row per group, are joined to the totals and so reach
    the rows by (partition, group), which no hot group can crowd.
    """
    order = [*order, F.col("_row")]
    keys = [F.col(c).asc_nulls_last() for c in group] + order
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    placed = cut(numbered.repartitionByRange(partitions(df.sparkSession), *keys).withColumn("_pid", F.spark_partition_id()), tag)
    inside = W.partitionBy("_pid", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*(group or [F.lit(0)])).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("_pid", *group).agg(F.sum(value).alias("_total"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    if facts is not None:
        renamed = facts.select(*(F.col(c).alias(f"_f_{c}") if c in group else F.col(c) for c in facts.columns))
        same = F.lit(True)
        for c in group:
            same = same & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
        totals = totals.join(renamed, same, "left").drop(*(f"_f_{c}" for c in group))
    totals = totals.select(*(F.col(c).alias(f"_g_{c}") if c in group else F.col(c) for c in totals.columns)).withColumnRenamed("_pid", "_at")
    here = F.col("_pid") == F.col("_at")
    for c in group:
        here = here & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    ran = placed.withColumn(out, F.sum(value).over(inside) - F.col(value))
    return ran.join(totals, here, "left").withColumn(out, F.col(out) + F.col("_before")).drop("_row", "_pid", "_at", "_before", *(f"_g_{c}" for c in group))


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of (a, b) long pairs: returns (node, root), root the smallest node reachable.

    Alternating large-star and small-star passes (Kiveris et al., 2014), each written to the shared folder;
    they end when a pass changes nothing. Minimum per node is a partial aggregate, so a node with very many
    links is reduced before the shuffle and never gathered into one task. Nodes without edges don't appear.
    """
    spark = edges.sparkSession

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        hang = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return hang.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def mark(e: DataFrame):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), tag)
    seen = mark(now)
    while True:
        after = cut(small_star(large_star(now)), tag)
        release(spark, now)
        now, was = after, seen
        seen = mark(now)
        if seen == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
