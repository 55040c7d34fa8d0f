"""A corpus pipeline of five stages: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns
of ``documents``; the last returns packed pieces. Every decision is about a row: a doc_id may be null or stand several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowforge.llm.common import NULL_ID, SPACES, hand_over, id_text, release, stage, table
from windowforge.llm.decontamination import build_indexes, find_leaks
from windowforge.llm.ngram_join import near_duplicates
from windowforge.llm.packing import pack_documents
from windowforge.llm.substring_dedup import dedup_words
from windowforge.llm.toxicity import score_documents, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    labelled = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(labelled, table(spark, sf_dir, "labels")), rows=True)
    return scored.where("score < 0.5").select("row.*")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the row with the least id stays (of equal ids by text; of equal rows one). Texts without words stay."""
    groups = near_duplicates(docs)
    first = stage(groups.where("stands_first AND n_shingles > 0").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("text_md5").alias("md5")).distinct())
    release(groups)
    keyed = id_text(docs, rows=True).select("id", F.unhex(F.md5("text")).alias("md5"), "row", (F.btrim("text", F.lit(SPACES)) == "").alias("blank"))
    kept = keyed.where("NOT blank").join(first, ["id", "md5"], "left_semi").dropDuplicates(["id", "md5"])
    return hand_over(kept.select("row.*").unionByName(keyed.where("blank").select("row.*")), first)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the passages that stand earlier; others keep every character."""
    cut, is_cut = dedup_words(docs, rows=True), F.col("n_removed") > 0
    new = {"text": F.when(is_cut, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(is_cut, F.length("kept_text")).otherwise(F.col("row.n_chars"))}
    return cut.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = find_leaks(docs, build_indexes(table(spark, sf_dir, "benchmark")), rows=True)
    return leaks.where("n_items = 0").select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents, cut and packed."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: No stage's model or packing can be put in SQL; tests/llm/test_pipeline_rows.py compares the rows that the first four stages keep or cut with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        before, out = docs, step(spark, docs, sf_dir)
        docs = stage(out)
        release(out, before)
    return docs
