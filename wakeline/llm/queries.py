"""The queries of this subpackage, and the SQL that DuckDB can run for some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import centroids, chat, decontaminate, embeddings, html, lines, mixing, quality, secrets, sharding, simhash, tokens, whitening
from wakeline.llm.common import scratch, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


def op2_pivot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        out = lines.remove_boilerplate(table(spark, sf_dir, "documents"))
        return keep(out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        out = mixing.mix(table(spark, sf_dir, "documents"))
        return keep(out.select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens"), F.col("_copies").alias("copies"), F.round("_weight", 9).alias("weight"), F.col("_order").alias("block_order")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), of("novel"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op11_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    one = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.round_trip(rows.unionByName(one))


def op12_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_pivot_vectors, op3_html_text, op4_benchmark_leaks, op5_simhash, op6_boilerplate_lines, op7_mixing, op8_secrets, op9_quality, op10_token_counts, op11_chat_tree, op12_hamerly, op13_whitening)}

ORACLES = {"op4_benchmark_leaks": decontaminate.ORACLE, "op6_boilerplate_lines": lines.ORACLE}
