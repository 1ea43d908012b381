"""Extendible hashing: documents into shards of a byte limit.

The directory is indexed by the leading bits of a 60-bit hash. It starts with one bucket; only a bucket
above the limit splits on another bit, until each fits. Several bits are looked at in one pass: bytes are
summed by the longest prefix of the pass, the sums of all shorter prefixes follow from those, and a bucket
is a leaf at the least depth at which it fits. That gives the same directory as splitting bit by bit. Later
passes read only the rows of buckets that are still above the limit.

The hash covers the id, the text and a running number among equal rows, so that repeated ids and groups of
identical rows spread like any others. DataFrame operations only.

Defined cases: a null text has 0 bytes; a document above the limit gets a shard of its own; an empty table
gives no rows; equal rows are kept, one result row each; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names

BITS = 60


def directory(rows: DataFrame, limit: int, step: int = 8, tag: str = "shards") -> DataFrame:
    """Add shard_depth, shard_prefix, shard_bytes and shard_docs to rows with _key (60 bits) and bytes."""
    names = rows.columns
    now = cut(rows, f"{tag}-rows")
    r = now.agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if (r["b"] or 0) <= limit or r["n"] <= 1:
        return now.select(*names, F.lit(0).alias("shard_depth"), F.lit(0).cast("long").alias("shard_prefix"), F.lit(r["b"] or 0).cast("long").alias("shard_bytes"), F.lit(r["n"]).cast("long").alias("shard_docs"))
    done, base = [], 0
    to = min(20, max(step, math.ceil(math.log2(r["b"] / limit)) + 3))
    while True:
        cells = now.groupBy(F.shiftright("_key", BITS - to).alias("_cell")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        levels = cells.withColumn("d", F.explode(F.sequence(F.lit(base + 1), F.lit(to))))
        levels = levels.withColumn("_up", F.expr(f"shiftright(_cell, {to} - d)"))
        nodes = levels.groupBy("d", "_up").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        fits = nodes.where((F.col("b") <= limit) | (F.col("n") == 1) | (F.col("d") == BITS))
        # the least depth at which the bucket of a cell fits
        of_cell = levels.select("_cell", "d", "_up").join(fits, ["d", "_up"]).groupBy("_cell").agg(F.min(F.struct("d", "_up", "b", "n")).alias("_leaf"))
        found = now.join(of_cell, F.shiftright("_key", BITS - to) == F.col("_cell"), "left")
        found = cut(found.select(*names, F.col("_leaf.d").alias("shard_depth"), F.col("_leaf._up").alias("shard_prefix"), F.col("_leaf.b").alias("shard_bytes"), F.col("_leaf.n").alias("shard_docs")), f"{tag}-{to}")
        done.append(found.where("shard_depth is not null"))
        now = found.where("shard_depth is null").select(*names)
        if to == BITS or now.isEmpty():
            break
        base, to = to, min(BITS, to + step)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def shard(docs: DataFrame, limit: int, tag: str = "shards") -> DataFrame:
    """One row per document: doc_id, digest (MD5 of the text), bytes, copy, shard_depth, shard_prefix, shard_bytes, shard_docs."""
    facts = docs.select("doc_id", F.md5("text").alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    same = facts.groupBy("doc_id", "digest", "bytes").agg(F.count(F.lit(1)).alias("_n"))
    rows = same.select("doc_id", "digest", "bytes", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("copy"))
    text = F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("digest", F.lit("")), F.col("copy").cast("string"))
    rows = rows.withColumn("_key", F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long"))
    return directory(rows, limit, tag=tag).drop("_key")


def write_shards(docs: DataFrame, limit: int, path: str) -> None:
    """Write docs with all their columns, one Parquet folder per shard. Rows that repeat id and text go where the first does, beyond the limit if they must.

    The column that names the shard is `shard`, with underscores before it if docs has one of that name.
    """
    own_id, own_digest, name = free_names(docs.columns, "shard_id", "shard_digest", "shard")
    at = shard(docs, limit).where("copy = 1").select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_digest), F.format_string("%d-%d", "shard_depth", "shard_prefix").alias(name))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & F.md5("text").eqNullSafe(F.col(own_digest))
    docs.join(at, same).drop(own_id, own_digest).repartition(name).write.partitionBy(name).parquet(path)
