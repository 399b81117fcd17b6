"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's documents. The first three keep or drop
documents, the fourth rewrites texts, the last encodes and decodes them.

Toxicity and near duplicates come from trained models and signatures, and
surrogates from keyed hashes, which SQL can't express, so there is no SQL. Near
duplicates, decontamination and tokens are tested against brute-force versions;
toxicity by its labels, and personal data by what must and must not change.

Defined cases, for every stage: null and empty texts are clean, are nobody's
near duplicate, contain no benchmark item and no personal data, and have no
tokens, so they stay. Rows with a null doc_id stay, too. Rows that share a
doc_id stay or go together as near duplicates, and one by one elsewhere. Of
copies the one with the smallest doc_id stays; repeated rows of it all stay. An
empty table gives an empty one. Other columns, whatever their names, are kept up
to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import bpe, containment, minhash, pii, toxicity
from tidebar.llm.shared import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject. The chain learns from the labels of the documents it gets."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id. 5-word shingles, similarity 0.8."""
    return minhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return containment.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the new text."""
    out = pii.replace_pii(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every document that is left."""
    return bpe.encode_and_decode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


ORACLE_SQL = None
