"""Quality rules by distribution divergence, with DataFrame and SQL functions only.

A document's histogram of character classes and its histogram of common words are compared with those of
its language by Jensen-Shannon distance (the root of the divergence to base 2, from 0 to 1). The references
are means over all documents of the language that pass the base rules. Common words are the function words
below, of any language, written as a word of their own; all other words share one bin. As a short text's
histogram strays further from its own source, the allowed distance of words grows with 1/sqrt(n_words);
texts under 50 words fail the base rules and are not compared.

One pass reads the texts and writes small facts per document; references and verdicts come from the facts.
A document without language, or of a language with fewer than `min_docs` sound documents, is compared with
the reference of all languages together.

Defined cases: a null or empty text has no words and fails the base rules; texts of any length are read
whole, in time n log n; repeated rows are judged one by one, alike; an empty table gives no rows; columns
other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
COMMON = sorted(
    set(
        "the of and to a in is that for it was on with as be by this are at from or have an not you they which but his her had were their".split()
        + "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split()
        + "le la les de des et en un une du dans que qui est pour par sur au plus pas ne se ce il sont avec son elle aux cette ont ou mais".split()
        + "el los las del y que en un una es por con para su al lo como más o pero sus le ha este sí porque esta son entre cuando muy sin sobre se no".split()
        + "di il che per non una del con gli da dei nel alla della si lo più come".split()
        + "do da em um para com não uma os no se na por mais as dos como mas ao ele das seu sua ou".split()
        + "het een van en dat te zijn op met voor niet aan er om ook als bij maar".split()
    )
)
CLASSES = [r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"#*$%&|<>", r".,;:!?'\"()\-"]


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def facts(docs: DataFrame) -> DataFrame:
    """Counts and histograms of every document: base fields, shares of character classes, counts of common words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select(
        "doc_id",
        "lang",
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"),
        F.length(text).cast("long").alias("_len"),
        F.array(*(_count(text, c) for c in CLASSES)).alias("_classes"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
    )
    n = F.size("_w")
    b = a.select(
        "doc_id",
        "lang",
        "_len",
        "_classes",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.array_sort(F.filter(F.transform("_w", F.lower), lambda w: w.isin(COMMON))).alias("_cw"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("_t"),
    )
    pairs = F.transform("_t", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    c = b.select(
        *("doc_id", "lang", "_len", "_classes", "n_words", "word_chars", "n_dup_lines", "_cw"),
        F.when(F.size(F.array_distinct("_t")) < F.size("_t"), F.sort_array(pairs)).alias("_s"),
        F.filter(F.sequence(F.lit(0), F.size("_cw")), lambda i: (i > 0) & ((i == F.size("_cw")) | (F.get("_cw", i) != F.get("_cw", i - 1)))).alias("_ends"),
    )
    twice = F.filter("_s", lambda x, i: (F.get("_s", i - 1)["h"] == x["h"]) | (F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False))))
    d = c.select(
        *("doc_id", "lang", "_len", "_classes", "n_words", "word_chars", "n_dup_lines"),
        F.sort_array(F.transform(twice, lambda x: x["p"])).alias("_p"),
        F.transform("_ends", lambda e, i: F.struct(F.array_position(F.array(*map(F.lit, COMMON)), F.get("_cw", e - 1)).cast("int").alias("word"), (e - F.when(i > 0, F.get("_ends", i - 1)).otherwise(0)).alias("n"))).alias("common"),
    )
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("_p", start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")), lambda s: s["n"])
    seen = F.aggregate("_classes", F.lit(0).cast("long"), lambda s, x: s + x)
    counts = F.concat("_classes", F.array(F.col("word_chars") - seen, F.col("_len") - F.col("word_chars")))
    out = d.select("doc_id", "lang", "n_words", "word_chars", F.get("_classes", F.lit(3)).alias("n_symbols"), "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.when(F.col("_len") > 0, F.transform(counts, lambda x: (x / F.col("_len")).cast("double"))).alias("classes"), "common")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def references(found: DataFrame, min_docs: int) -> DataFrame:
    """Mean histograms: one row per language, and one with null ref over all: ref, ref_classes, ref_words (by number of the word)."""
    sound = found.where(~F.col("base_failed"))
    langs = sound.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("lang").isNotNull() & (F.col("n") >= min_docs)).select(F.col("lang").alias("ref"))
    for_all = F.lit(None).cast("string")
    # a row without language counts under null once
    rows = sound.select(F.explode(F.when(F.col("lang").isNull(), F.array(for_all)).otherwise(F.array(F.col("lang"), for_all))).alias("ref"), "n_words", "classes", "common")
    many = len(CLASSES) + 2
    means = rows.groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(F.get("classes", F.lit(i))) for i in range(many))).alias("ref_classes"))
    words = rows.select("ref", "n_words", F.inline("common")).groupBy("ref", "word").agg(F.sum(F.col("n") / F.col("n_words")).alias("s"))
    words = words.groupBy("ref").agg(F.map_from_entries(F.collect_list(F.struct("word", "s"))).alias("_sums"))  # at most one entry per common word
    shares = F.transform(F.sequence(F.lit(1), F.lit(len(COMMON))), lambda i: F.coalesce(F.element_at("_sums", i) / F.col("n"), F.lit(0.0)))
    out = means.join(words, means["ref"].eqNullSafe(words["ref"]), "left").select(means["ref"], "n", "ref_classes", shares.alias("ref_words"))
    known = out.join(langs, "ref", "left_semi")
    return known.select("ref", "ref_classes", "ref_words").unionByName(out.where("ref is null").select("ref", "ref_classes", "ref_words"))


def _half(p: Column, q: Column) -> Column:
    """The share of one bin in the Jensen-Shannon divergence."""
    m = p + q
    return F.when(p > 0, p / 2 * F.log2(2 * p / m)).otherwise(0.0) + F.when(q > 0, q / 2 * F.log2(2 * q / m)).otherwise(0.0)


def _distances(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Add class_distance and word_distance (null where the base rules failed)."""
    known = refs.where("ref is not null").select(F.col("ref").alias("lang"), F.lit(True).alias("_known"))
    found = found.join(known, "lang", "left").withColumn("_ref", F.when(F.col("_known"), F.col("lang")))
    both = found.join(refs, found["_ref"].eqNullSafe(refs["ref"]), "left")
    zero = F.lit(0.0)
    classes = F.aggregate(F.zip_with("classes", "ref_classes", _half), zero, lambda s, x: s + x)
    share = lambda x: x["n"] / F.col("n_words")
    ref = lambda x: F.get("ref_words", x["word"] - 1)
    both = both.withColumn("_bins", F.transform("common", lambda x: F.struct(share(x).alias("p"), ref(x).alias("q"))))
    inside = F.aggregate("_bins", F.struct(zero.alias("d"), zero.alias("p"), zero.alias("q")), lambda s, x: F.struct((s["d"] + _half(x["p"], x["q"])).alias("d"), (s["p"] + x["p"]).alias("p"), (s["q"] + x["q"]).alias("q")))
    both = both.withColumn("_in", inside).withColumn("_all", F.aggregate("ref_words", zero, lambda s, x: s + x))
    # bins that the document lacks give half their reference share; the rest of the words is the last bin
    rest = _half(F.greatest(zero, 1 - F.col("_in.p")), F.greatest(zero, 1 - F.col("_all")))
    words = F.col("_in.d") + F.greatest(zero, F.col("_all") - F.col("_in.q")) / 2 + rest
    judged = ~F.col("base_failed")
    both = both.withColumn("class_distance", F.when(judged, F.sqrt(F.greatest(zero, classes)))).withColumn("word_distance", F.when(judged, F.sqrt(F.greatest(zero, words))))
    return both.drop("_known", "_ref", "ref", "ref_classes", "ref_words", "_bins", "_in", "_all")


def judge(docs: DataFrame, max_classes: float = 0.158, max_words: float = 0.32, word_slack: float = 2.2, min_docs: int = 20, passes: int = 2, tag: str = "quality") -> DataFrame:
    """Base fields, base_failed, class_distance, word_distance and kept of every document.

    The first references are of all sound documents; each further pass takes those that the one before
    kept, so that junk doesn't pull the references its own way. The text is read once.
    """
    found = cut(facts(docs), f"{tag}-facts")
    good = (F.col("class_distance") <= max_classes) & (F.col("word_distance") <= F.lit(max_words) + F.lit(word_slack) / F.sqrt("n_words"))
    names, kept, sound = found.columns, found, found
    for k in range(passes):
        refs = cut(references(sound, min_docs), f"{tag}-references-{k}")
        kept = _distances(found, refs).withColumn("kept", F.coalesce(~F.col("base_failed") & good, F.lit(False)))
        if k + 1 < passes:  # written, as the next references read it several times
            sound = cut(kept.where("kept").select(*names), f"{tag}-sound-{k}")
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
