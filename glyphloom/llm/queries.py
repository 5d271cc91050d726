"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import language, licenses, lloyd, permutation, runs, tokenfile, topk, toxicity, urlfilter
from glyphloom.llm.mixing import mix_copies
from glyphloom.llm.neardup import near_duplicates
from glyphloom.llm.packing import pack
from glyphloom.llm.suffixdedup import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs, licenses.build_index(docs)).drop("text")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))  # n_bytes is the size before; this is what is left


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_languages(language.learning_rows(docs))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = language.held_out(F.col("doc_id"), 3, 1)
    rows = toxicity.with_labels(docs.where(~held), table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(rows))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix_copies(table(spark, sf_dir, "documents"))
    return taken.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.lloyd(table(spark, sf_dir, "embeddings")).vectors


def op12_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokenfile.read_token_files(spark, folder)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_language_id": op5_language_id,
    "op6_permutation_ann": op6_permutation_ann,
    "op7_source_mixing": op7_source_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_length_buckets": op9_length_buckets,
    "op10_exact_topk": op10_exact_topk,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_token_binary": op12_token_binary,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE = {"op3_url_filter": urlfilter.ORACLE, "op10_exact_topk": topk.ORACLE,
          "op11_centroid_clustering": lloyd.ORACLE}
