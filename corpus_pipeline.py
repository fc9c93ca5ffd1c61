"""The corpus pipeline: language ID, near-duplicates, decontamination, secrets, tokens.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of documents. run() writes each stage's result to the shared folder and reads it again.

Defined cases, of every stage: null and empty texts, texts of any length, ties, repeated rows and null ids are taken as the stage's operator says; columns
besides those of documents are dropped by all but the last, which gives its own three; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.llm import bpe, contamination, langid, secrets, simhash
from entigraph.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (`und`) go; the others get the language that their n-grams are nearest to."""
    learned = langid.learn(docs.select("lang", "text"))
    out = langid.predict(docs.select(*COLUMNS), learned)
    return out.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id stays."""
    return simhash.first_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark windows go."""
    return contamination.contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; all documents stay."""
    out = secrets.scan(docs.select(*COLUMNS), secrets.model_of(docs)).withColumn("text", secrets.masked("text", "spans"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document; a null text is encoded as an empty one, without ids."""
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents of sf_dir; benchmark is the other table that is read."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{i + 1}")
    return docs
