"""The queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = None  # a folder of vocabulary files; None: that of the public_tokenizers package


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(by: int) -> F.Column:
    """crc32 of doc_id as text, modulo ``by``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(by))


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratamine.llm.lm import score

    return score(table(spark, sf_dir, "documents"), remainder(7) == 2)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratamine.llm.tokens import encode

    made = encode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), decoded=True)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratamine.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratamine.llm.jaccard import join

    return join(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op5_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratamine.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratamine.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents")).drop("codes")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratamine.llm.toxicity import assess, fit

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = assess(docs, fit(docs, labels, remainder(4) != 2))
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratamine.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs, remainder(3) != 1))
    return found.withColumn("held_out", F.coalesce(remainder(3) == 1, F.lit(False)))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratamine.llm.tokens import count_tokens

    counted = count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratamine.llm.secrets import find_secrets, joined

    found = find_secrets(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
