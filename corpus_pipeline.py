"""A training-data pipeline over documents: language, toxicity, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents and drop any others, so no name can clash. SQL can't
express the stages; tests hold them against brute force. An empty table gives an empty one at every stage. Repeated rows
and ids are judged and kept row by row by all stages but near_copies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamine.llm.queries import table, tokenizer
from stratamine.llm.ship import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no language: no text or no letter, or bits that fit no codeword.

    Ties between languages go to the first by name. Without any language to learn from none is kept.
    """
    from stratamine.llm.langid import fit, with_language

    model = fit(docs, F.lit(True))
    return with_language(docs, model).where("lang_pred <> 'und' and score >= 0.3").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose calibrated toxicity reaches the threshold. Without labels of both kinds the score is the
    share of toxic ones, so all documents stay or, where every label is toxic, none."""
    from stratamine.llm.toxicity import fit, with_toxicity

    model = fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return with_toxicity(docs, model).where("predicted = 0").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at 0.8 connect: that with the smallest id.

    Rows that share an id are one document: of them the least row by text, then by the other columns, stays. Rows without
    an id, and those without a word, link with nothing and all stay, but for rows that repeat an id.
    """
    from stratamine.llm.jaccard import join

    found = join(docs, words=5, num=8, den=10)
    first = found.where("component_id = doc_id").select(F.col("doc_id").alias("f_id")).distinct()
    kept = docs.where("doc_id is not null").select(*COLUMNS).join(first, F.col("doc_id") == F.col("f_id"), "left_semi")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        least = F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")
        kept = kept.groupBy("doc_id").agg(least).select("doc_id", *(f"row.{c}" for c in COLUMNS[1:]))
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With every secret replaced; n_chars is counted anew. A null text stays null, and so does its n_chars."""
    from stratamine.llm.secrets import redact

    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids in sequences; a document without text is its end id alone, repeated rows each are packed."""
    from stratamine.llm.packing import pack

    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language", language), ("toxicity", toxicity), ("near_copies", near_copies), ("secrets", secrets), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the folder in spark.checkpoint.dir and read again."""
    docs = table(spark, sf_dir, "documents")
    ship(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    name = uuid.uuid4().hex
    for step, f in STAGES[:-1]:
        path = f"{base}/pipeline-{name}/{step}"
        f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
