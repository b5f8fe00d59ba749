"""A training-data pipeline: quality, toxicity, near duplicates, benchmark decontamination, and token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; run() writes every result to the
shared folder and reads it again, so a lost executor never costs more than the stage at hand. Of every stage an empty table
leaves an empty one; columns that the stage doesn't name are carried along, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortis.llm import bpe, common, decontam, quality, queries, simhash, toxicity


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the hierarchical quality classifier rejects. A null or empty text has no evidence and stands as its
    site does; null sources and languages are one site; repeated rows are judged alike; very long texts whole."""
    return quality.accepted(docs, queries.table(spark, sf_dir, "labels"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic documents. The lexicon is learnt from the labelled documents of the whole table. A null or empty text scores
    least and stays; repeated rows score alike; very long texts are scored whole."""
    model = queries.toxicity_model(spark, sf_dir)
    return docs.where(toxicity.score_udf(spark, model)(F.col("text")) < toxicity.THRESHOLD)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the smallest doc_id (null ids last; ties by a hash of the text, and of
    rows equal in both any one). Texts without words, null or empty, are copies of one another."""
    return simhash.deduplicated(docs)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item, whether or not the item has an id. Null and empty texts stay;
    repeated rows are judged alike; very long texts are read in overlapping pieces."""
    return decontam.remove_documents(docs, queries.table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of token ids, and digests of the ids and of the decoded text. A null text counts as empty: no ids;
    null ids and repeated rows stay."""
    lexicon = bpe.compile_lexicon(docs, queries.tokenizer("word_bpe_49k.json"))
    coded = bpe.encode_texts(docs, lexicon, decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("quality", keep_quality), ("toxicity", keep_civil), ("near_duplicates", keep_one_of_each), ("decontamination", keep_unseen), ("tokens", to_tokens)]

#: The stages learn from data and follow links; SQL can't express them. They are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
