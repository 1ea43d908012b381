"""A corpus pipeline of five of the llm operators; run() applies its stages to the documents table.

Each stage takes the rows that the one before it wrote. All but the last return the columns of documents:
language ID drops what it rejects, SimHash near-dedup keeps one document of each class, substring dedup
rewrites texts (and n_chars) without their repeated passages, mixing gives every document as often as its
source's target asks, in training order, and packing returns the pieces with their places in sequences.

Defined cases, stage by stage. Language ID: a null text or one without a letter goes; if nothing can be learned
all rows stay; equal rows are judged alike. Near-dedup: null texts stay, each alone; equal texts are one class,
and of a class the row with the smallest doc_id stays (a null one only where all are null, one row of those that
repeat id and text). Substring dedup: all rows stay; a null doc_id neither removes nor loses words; rows with
equal ids don't count as smaller than each other; a text may become empty. Mixing: null is a source of its own;
documents without a word, and those past their source's target, are taken by no copy; repeated rows give the
copies of all of them. Packing: a null text is empty, one piece with the end id alone; repeated rows are packed
as often as they come. Texts are read whole, further columns pass through whatever their names (packing returns
its own columns), and an empty table gives an empty one at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, mixing, packing, simhash, substrings
from tessera.llm.common import cut, held_out, passing, release


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs.where(~held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.rewrite(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None  # clustering, SimHash candidates and best-fit supersteps aren't SQL; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order, each one's rows written as Parquet and read again; what a stage leaves goes with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with passing(spark) as keep:
            docs = keep(cut(stage(spark, before, sf_dir), f"stage-{k}-{name}"))
        if k:
            release(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
