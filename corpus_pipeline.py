"""The corpus pipeline: language identification, line dedup, near-duplicate removal, benchmark decontamination and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and reads it again as the
next stage's documents. All but the last return the columns of ``documents``.

Edge cases: nulls in any column, empty tables and columns beyond those of ``documents`` go through as each operator says; extra columns are
not carried on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import jaccard_join, language_id, line_dedup
from textloom.llm.common import among, discard, stored
from textloom.llm.decontaminate import contamination
from textloom.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those in which no language has at least half."""
    docs = docs.select(COLUMNS)
    found = language_id.predict(docs, language_id.learn(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that had only such lines goes too."""
    docs = docs.select(COLUMNS)
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    kept = cut.where((F.col("n_dropped") < F.col("n_lines")))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id. Rows that repeat a doc_id stay or go together, by the set that the join compares (the least
    digest); of those that stay, only rows with the same text become one (with the least of the other columns), so the texts left don't change between runs.
    Texts move only for ids that repeat, unless the ids that go are too many to broadcast."""
    docs = docs.select(COLUMNS)
    losers = stored(jaccard_join.joined_documents(docs).where("not kept").select("doc_id"), "losers")
    again = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    kept = among(docs, losers, "doc_id", "left_anti")
    if again.isEmpty():
        return kept
    rest = F.min(F.struct(*[c for c in COLUMNS if c not in ("doc_id", "text")])).alias("rest")
    merged = among(kept, again, "doc_id").groupBy("doc_id", "text").agg(rest).select("doc_id", "text", "rest.*").select(COLUMNS)
    return among(kept, again, "doc_id", "left_anti").unionByName(merged)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs.select(COLUMNS), bench).where(F.size("hits") == 0).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

#: The first and last stages can't be said in SQL; tests hold the stages against what was planted and the last against the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, out = out, stored(stage(spark, out, sf_dir), name)
        if k:
            discard(before)
    return STAGES[-1][1](spark, out, sf_dir)
