"""From raw documents to packed training sequences.

Five stages, each over all that the one before kept: language identification
(documents without a language go), near-duplicates (one of each group stays),
benchmark decontamination (documents with a hit go), secrets (masked in the
text) and packing. Each stage's result is written as Parquet in the shared
folder and read again by the next, so a lost executor costs a stage at most.

In every stage an empty table gives an empty result, columns beside those named
stay as they are whatever their names, and repeated rows are judged row by row
(near-duplicates: see there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmail.llm.decontaminate import drop_contaminated
from sparkmail.llm.language import fit_profiles, held_out, keep_identified
from sparkmail.llm.near_dup import drop_near_duplicates
from sparkmail.llm.packing import pack
from sparkmail.llm.secret_scan import redact
from sparkmail.session import stage_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; profiles are fitted on the labels of the documents that are not held out.

    Null and empty texts and those without a letter go. A null id is not used for fitting; a null ``lang`` neither.
    Without any label only texts without a letter go."""
    profiles = fit_profiles(docs.where(~held_out(F.col("doc_id"))), "text", "lang")
    return keep_identified(docs, profiles)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more.

    The smallest id stays, with all rows that repeat it. Null ids stay; null and empty texts resemble nothing and stay."""
    return drop_near_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten consecutive words (or no whole shorter item) with the benchmark.

    Null and empty texts share none and stay; rows with a null or repeated id are judged by their own texts."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; ``n_chars``, if there, is that of the masked text (null for a null text)."""
    masked = redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; a null or empty text is its end token alone."""
    return pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("packing", packing)]

#: SQL cannot state the stages; they are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents`` of ``sf_dir``; jobs run when called, the last stage's when read."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
