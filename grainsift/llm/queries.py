"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..queries.registry import Builder, Query, prepared
from . import (clustering, decontaminate, filteraudit, jaccard, licences, linededup, mainhtml, oracle_sql, pieces, quality, secretscan,
               substrings, tokenfile, vectors)

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build: Builder) -> Builder:
        QUERIES[name] = Query(prepared(build), sql)
        return build

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@query("op4_decontaminate", oracle_sql.DECONTAMINATE)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_passages(
        table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"),
        drop_text=True)
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"))


@query("op5_sentencepiece")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    encoded = pieces.encode(table(spark, folder, "documents", "doc_id", "text"),
                            public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        F.col("key").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op6_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfile.token_table(table(spark, folder, "documents", "doc_id", "text"),
                                 public_tokenizers.path("word_bpe_49k.json"))


@query("op7_repeated_passages", oracle_sql.REPEATED_PASSAGES)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, folder, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op3_jaccard_join", oracle_sql.JACCARD)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_groups(table(spark, folder, "documents", "doc_id", "text"))


@query("op2_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    labels = table(spark, folder, "labels", "doc_id", "quality").filter(~quality.held_out())
    scored = quality.score(docs, quality.train(docs, labels), drop_text=True)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op1_embedding_neardup", oracle_sql.EMBEDDING_NEARDUP)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings", "vec_id", "embedding"))


@query("op10_main_text")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", "page_id", "url", "html")
    found = mainhtml.extract(pages, mainhtml.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op8_secret_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    forest = secretscan.train(words=secretscan.dictionary(public_tokenizers.path("word_bpe_49k.json")))
    found = secretscan.scan(table(spark, folder, "documents", "doc_id", "text"), forest)
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda s: F.concat_ws("-", s["starts"], s["ends"]))
    return found.select(
        "doc_id", "n_candidates", F.size("starts").cast("bigint").alias("n_secrets"), F.array_join(spans, ",").alias("spans"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("masked_sha256"))


@query("op9_licences")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = licences.scan(docs, licences.train(docs))
    families = F.array_sort(F.array_distinct(F.transform("licences", lambda s: s["family"])))
    return found.select("doc_id", F.size("licences").cast("bigint").alias("n_licences"),
                        F.array_join(families, ",").alias("families"),
                        F.array_join(F.transform("licences", lambda s: s["line"].cast("string")), ",").alias("lines"))


@query("op11_centroid_clusters", oracle_sql.CENTROID_CLUSTERS)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster(table(spark, folder, "embeddings", "vec_id", "embedding"))


@query("op12_filter_audit", oracle_sql.FILTER_AUDIT)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return filteraudit.audit(table(spark, folder, "documents", "doc_id", "source", "text"),
                             table(spark, folder, "labels", "doc_id", "quality", "toxic"))


@query("op13_line_dedup", oracle_sql.LINE_DEDUP)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = linededup.drop_lines(table(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
