"""The corpus pipeline: documents through five stages, each one operator, rejected documents leave.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.llm import langid, pieces, scratch, toxicity
from gridscope.llm.mixing import mix_documents
from gridscope.llm.queries import PIECE_MODEL, table
from gridscope.llm.simhash import drop_near_duplicates


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic leave."""
    score, verdict = scratch.fresh(docs, "toxic_score"), scratch.fresh(docs, "toxic_predicted")
    found = toxicity.detect(docs, table(spark, sf_dir, "labels"), score_col=score, predicted_col=verdict)
    return found.where(F.col(verdict) == 0).select(*docs.columns)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits no known language (noise, unknown scripts: no model later learns from them) leave."""
    return langid.keep_known(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weights, documents repeated by epochs."""
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, and the number of tokens of each document."""
    found = pieces.encode_column(docs, pieces.load(PIECE_MODEL), decoded=None)
    return found.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_languages),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that STAGES make of documents; each stage but the last is written to the shared folder and reread, so it runs once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and bit signatures have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
