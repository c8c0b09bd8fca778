"""The corpus pipeline: quality rules, near and substring dedup, mixing, tokens.

A null text counts as empty, a null source as a source of its own. Rows without a doc_id are no near copies of
others, and stay; of rows equal in doc_id and text one stays; different texts that share a doc_id are judged apart.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, mixing, quality_rules, simhash, suffix_dedup
from quillon.llm.common import release, scratch, scratch_path, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a passage that goes where it repeats: it may have fewer than 400 bytes.
PASSAGE = 50

#: Scratch tables of the stage before: its result is stored by the time that the next stage begins.
_held: list[str] = []


def stage(f):
    @wraps(f)
    def tidy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _held)
        small_batches(spark)
        before = set(scratch(spark))
        out = f(spark, docs, sf_dir)
        _held[:] = [p for p in scratch(spark) if p not in before]
        return out

    return tidy


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that with the smallest doc_id."""
    docs = docs.select(*COLUMNS)
    return simhash.keep_one(docs, simhash.similar_groups(docs.where("doc_id is not null"))).select(*COLUMNS)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes and the passages of 50 words that are also elsewhere; what is left of a cut character goes too."""
    out = suffix_dedup.remove_repeats(docs.select(*COLUMNS), as_text=True, passage=PASSAGE, cut_passages=True).withColumn("text", F.col("kept"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order in which the schedule takes the sources' blocks: part files and their rows keep it."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def in_order(docs: DataFrame) -> DataFrame:
    """docs with `position`, a number that rises from row to row of their part files; null if they aren't read from part files."""
    try:
        docs = docs.select("*", "_metadata.file_name", "_metadata.row_index")
    except AnalysisException:  # no files
        return docs.withColumn("position", F.lit(None).cast("long"))
    part, more = (F.coalesce(F.regexp_extract("file_name", f, 1).try_cast("long"), F.lit(0)) for f in (r"^part-(\d+)", r"-c(\d+)\."))
    named = F.col("file_name").rlike(r"^part-\d+")
    return docs.withColumn("position", F.when(named, F.shiftleft(part, 42) + F.shiftleft(more, 32) + F.col("row_index"))).drop("file_name", "row_index")


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position (rises in the order of mixing), n_tokens, ids (unsigned 32-bit, little-endian) and the digest of what they decode to."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = bpe.round_trip(in_order(docs.select(*COLUMNS)), ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", "position", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing", mixed), ("tokens", tokens)]
# Neither the trained rules nor fingerprints, byte strings and tokens can be had in SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, own in STAGES[:-1]:
        out = own(spark, docs, sf_dir)
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        out.write.parquet(path)
        if before:
            release(spark, [before])
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
