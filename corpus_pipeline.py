"""A corpus pipeline: drop toxic and poor documents, keep one of each near-duplicate group, redact personal data, pack.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last return the columns of
documents, and further columns of ``docs`` are not read.  Every row is judged by itself: null texts count as empty but stay null,
rows without an id or with one that others have too are rows like any other, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import best_fit_packing, ngram_jaccard_join, pii, quality_rules, toxicity
from plumbline.llm._storage import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keys() -> list[Column]:
    """What joins know a row by: rows that share both have one text, so one verdict."""
    return [ngram_jaccard_join.id_of(F.col("doc_id")).alias("_id"), ngram_jaccard_join.digest(F.col("text")).alias("_digest")]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier does not predict as toxic, each by its own text; repeated rows go or stay together.

    The labels of ``sf_dir`` teach it; without any, and for texts without a word of its lexicon, no row is toxic.
    """
    keyed = docs.select(*COLUMNS, *_keys())
    scored = toxicity.score(keyed, table(spark, sf_dir, "labels"), keep=("_digest",))
    toxic = scored.where(F.col("predicted") == 1).select(ngram_jaccard_join.id_of(F.col("doc_id")).alias("_id"), "_digest")
    return keyed.join(cut(toxic.distinct()), ["_id", "_digest"], "left_anti").select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that break no quality rule; a null or empty text is too short.  Repeated rows go or stay together."""
    return quality_rules.apply_rules(docs).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of copies and near copies, that of the least id.

    A row without an id stays only where its whole group has none; of repeated rows one stays, and of several texts
    under one id each that stands for its group.
    """
    kept = ngram_jaccard_join.representatives(docs).toDF("_id", "_digest")
    # repeated rows meet before the join, so that a row that is there very often is no hot key of it
    single = docs.select(*COLUMNS).groupBy(*_keys()).agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return single.join(kept, ["_id", "_digest"], "left_semi").select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by the name of its kind, and ``n_chars`` of the new text (null for a null one)."""
    redacted = pii.redact(docs.select(*COLUMNS))
    return redacted.withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row lies in the packed sequences; a null or empty text is one token, its separator."""
    return best_fit_packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot state the fitted classifiers, MinHash or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
