"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1, linear between its points. Its integral over
the whole time is the source's weight; targets share the budget by these weights, stop at `repeats` times
the source's size, and the excess is shared again by weight (water filling) until no source is above. By
time t a source is to have given target * integral(0..t) / integral(0..1) words; inverting this cumulative
demand turns a document's place in its source, in an order by digest, into its training position. A source
runs through its documents as often as its target asks; the last run ends where the demand ends, inside a
document where need be. Documents are then range-sorted by position.

Nothing is gathered by source: sums before a document are distributed prefix sums, so a source with a
third of all rows costs as much as the same rows in many sources.

Defined cases: a null text has size 0; null is a source of its own, ordered last; a source without words
has target 0; documents of size 0 take nothing and have a null position; rows with equal doc_id count one by
one, ordered by their texts; rows equal in id, source and text may change places, which changes no result;
columns other than doc_id, source and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, exactly, free_names, ordered_offsets, partitions

WORD = r"[^\x20\x09-\x0D]+"


def ramp(rank: Column) -> Column:
    """The default schedule: weights 1, 2, 3 by turns; even ranks grow from half to one and a half of it, odd ones fall."""
    weight = (rank % 3 + 1).cast("double")
    up = rank % 2 == 0
    low, high = F.lit(0.5) * weight, F.lit(1.5) * weight
    return F.array(
        F.struct(F.lit(0.0).alias("t"), F.when(up, low).otherwise(high).alias("w")),
        F.struct(F.lit(1.0).alias("t"), F.when(up, high).otherwise(low).alias("w")),
    )


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, budget: float, repeats: float) -> DataFrame:
    """Add target to (source_size, weight) rows: least(repeats * size, level * weight) with the level that spends the budget.

    Each pass is one aggregate; a level only rises, so what it caps stays capped and the passes end.
    """
    cap = F.col("source_size") * F.lit(float(repeats))
    level = 0.0
    while True:
        capped = cap <= F.lit(level) * F.col("weight")
        r = sources.agg(F.sum(F.when(capped, cap).otherwise(0.0)).alias("spent"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        higher = (budget - r["spent"]) / r["open"] if r["open"] else level
        if not r["open"] or higher <= level:
            return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")) if r["open"] else cap)
        level = higher


def _integral(points: Column) -> Column:
    """Points with the integral up to each: array of (t, w, slope, area)."""
    start = F.struct(F.array().cast("array<struct<t:double,w:double,slope:double,area:double>>").alias("out"), F.lit(0.0).alias("area"))

    def add(acc: Column, i: Column) -> Column:
        p = F.get(points, i)
        n = F.get(points, i + 1)
        long = n["t"] - p["t"]
        slope = F.when(long > 0, (n["w"] - p["w"]) / long).otherwise(0.0)
        row = F.struct(p["t"].alias("t"), p["w"].alias("w"), slope.alias("slope"), acc["area"].alias("area"))
        return F.struct(F.concat(acc["out"], F.array(row)).alias("out"), (acc["area"] + (p["w"] + n["w"]) / 2 * long).alias("area"))

    return F.aggregate(F.sequence(F.lit(0), F.size(points) - 2), start, add)


def mix(docs: DataFrame, schedule: Callable[[Column], Column] = ramp, repeats: float = 3.0, budget: float | None = None, carry: tuple[str, ...] = (), tag: str = "mix") -> DataFrame:
    """One row per document, range-sorted by its first position.

    Returns doc_id, source, size, source_size, target, taken, position (of the first copy; null if nothing is
    taken) and copies: array of (copy, words, position). schedule maps a source's rank to its points, at least
    two, (t, w) from t = 0 to t = 1; budget defaults to the sum of all sizes.
    """
    sized = cut(docs.select("doc_id", "source", word_count("text").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_h"), F.xxhash64("text").alias("_t"), *map(exactly, carry)), f"{tag}-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1).cast("long"))
    ranked = ordered_offsets(sources, [F.col("source").asc_nulls_last()], [], "_one", "_rank", f"{tag}-sources")
    ranked = ranked.withColumn("_curve", _integral(schedule(F.col("_rank")))).withColumn("weight", F.col("_curve.area"))
    ranked = cut(ranked.select("source", "source_size", "weight", F.col("_curve.out").alias("_curve")), f"{tag}-weights")
    total = budget if budget is not None else (ranked.agg(F.sum("source_size")).first()[0] or 0)
    facts = source_targets(ranked, float(total), repeats).withColumn("_take", F.floor(F.col("target") + 0.5).cast("long"))
    placed = ordered_offsets(sized, [F.col("_h"), F.col("doc_id"), F.col("_t"), F.col("size")], ["source"], "size", "_start", f"{tag}-order", facts)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("_take") / F.col("source_size"))).otherwise(0).cast("long")

    def copy(k: Column) -> Column:
        words = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("_take") - k * F.col("source_size") - F.col("_start")))
        done = (k * F.col("source_size") + F.col("_start")) / F.col("_take") * F.col("weight")
        at = F.element_at(F.filter(F.col("_curve"), lambda p: (p["area"] <= done)), -1)
        area = done - at["area"]
        step = at["w"] + F.sqrt(at["w"] * at["w"] + 2 * at["slope"] * area)
        position = at["t"] + F.when(step > 0, 2 * area / step).otherwise(0.0)
        return F.struct(k.cast("int").alias("copy"), words.alias("words"), F.when(words > 0, position).alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), whole), copy), lambda c: c["words"] > 0)
    out = placed.withColumn("copies", F.when((F.col("size") > 0) & (F.col("_take") > 0), copies).otherwise(F.array().cast("array<struct<copy:int,words:bigint,position:double>>")))
    out = out.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])).withColumn("position", F.get("copies", F.lit(0))["position"])
    out = out.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "copies", *map(exactly, carry))
    return out.repartitionByRange(partitions(docs.sparkSession), F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy that the mix takes, range-sorted by training position: doc_id, copy, words, position."""
    rows = mixed.select("doc_id", F.inline("copies"))
    return rows.repartitionByRange(partitions(mixed.sparkSession), "position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs in training order, each as often as the mix takes it, all columns kept.

    A last copy that the mix takes in part has the first words of the text, joined by one space; n_chars, if
    there, follows. Rows that repeat id, source and text give the copies of all of them, with one's columns.
    """
    own, _id, _source, _d, _size, _copy, _words, _position = free_names(docs.columns, "mix_text", "mix_id", "mix_source", "mix_digest", "mix_size", "mix_copy", "mix_words", "mix_position")
    digest = F.sha2("text", 256)
    mixed = mix(docs.select("doc_id", "source", "text", digest.alias(own)), carry=(own,), **settings).where("taken > 0")
    flat = mixed.select(F.col("doc_id").alias(_id), F.col("source").alias(_source), F.col(own).alias(_d), F.col("size").alias(_size), F.inline("copies").alias(_copy, _words, _position))
    flat = cut(flat, "mix-copies")
    many = flat.where(F.col(_copy) == 0).groupBy(_id, _source, _d).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    keyed = docs.withColumn(own, digest)
    if not many.isEmpty():
        keyed = keyed.dropDuplicates(["doc_id", "source", own])
    same = F.col("doc_id").eqNullSafe(F.col(_id)) & F.col("source").eqNullSafe(F.col(_source)) & (F.col(own) == F.col(_d))
    rows = keyed.join(flat, same)
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col(_words).cast("int")), " ")
    short = F.col(_words) < F.col(_size)
    new = {"text": F.when(short, part).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(short, F.length(part).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    # doc_id and place are the sort keys before the columns of docs alone are left
    rows = rows.select(*(new[c].alias(c) if c in new else exactly(c) for c in docs.columns), _position)
    rows = rows.repartitionByRange(partitions(docs.sparkSession), _position, "doc_id").sortWithinPartitions(_position, "doc_id")
    return rows.select(*map(exactly, docs.columns))
