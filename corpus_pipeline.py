"""The corpus pipeline: five stages from raw documents to token ids.

quality classifier -> Jaccard join -> benchmark decontamination -> secret scan -> encoding.
Each stage takes (spark, docs, sf_dir), works on all rows that the one before has kept and
returns a DataFrame; ``run`` writes each result as Parquet and reads it again. All but the
last return the columns of documents. Null and empty texts stay unless the classifier
rejects them; rows with the same id and text count as copies and one of them stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from grainsift.llm import decontaminate, jaccard, pieces, quality, secretscan
from grainsift.llm.common import free_name, stored
from grainsift.queries.registry import Query
from grainsift.session import delete_folders, work_folders


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 80% of their five-word runs the one with the smallest id stays."""
    return jaccard.keep_first(docs, size=5, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows."""
    names = tuple(free_name(docs.columns, n) for n in ("n_candidates", "starts", "ends"))
    words = secretscan.dictionary(public_tokenizers.path("word_bpe_49k.json"))
    found = secretscan.scan(docs, secretscan.train(words=words), names=names)
    changed = F.size(names[1]) > 0
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).drop(*names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and digests of them and of the decoded text."""
    encoded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        F.col("key").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminate_benchmark),
    ("secret scan", mask_secrets),
    ("SentencePiece encoding", encode),
]

ORACLE_SQL = None  # learned models and a tokenizer; tests/llm/test_pipeline.py holds each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = len(work_folders())
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        delete_folders(spark, work_folders()[before:-1])  # all but the result, which is the last one made
    return docs


QUERIES = {"pipeline": Query(run, ORACLE_SQL)}
