"""Queries over the tables of one folder: one thin query per operator of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardiolake.llm import (
    clustering,
    importance,
    jaccard,
    langid,
    licences,
    lm,
    mixing,
    neighbours,
    packing,
    simhash,
    substrings,
    syncmers,
    token_file,
)
from cardiolake.llm.shared import fold
from cardiolake.llm.statements import STATEMENTS  # noqa: F401  read by the entry

# Known pieces that a task of op3 and op6 holds: about 160 MB. The pipeline's tasks hold other tables too and take fewer.
PIECES = 800_000

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_syncmer_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.fingerprints(documents(spark, folder))


def op2_cross_polytope_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return neighbours.search(vectors, F.col("vec_id") % 100 == 0, k=10)


def op3_power_of_two_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(documents(spark, folder), vocabulary("byte_bpe_50k.json"), end_id=0, most=1024, max_words=PIECES)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return substrings.deduplicate(docs).withColumn("n_removed", F.size("removed"))


def op5_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.groups(documents(spark, folder), radius=4)


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    found = token_file.roundtrip(documents(spark, folder), vocabulary("word_bpe_49k.json"), end_id=1, max_words=PIECES)
    n_tokens = F.expr("octet_length(ids) div 4")
    return found.select("doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_licence_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = licences.scan(docs, licences.fit(docs))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",")
    return found.select("doc_id", families.alias("families"), F.size("licences").alias("n_notices"), "licences")


def op8_byte_cnn_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4, 2)
    found = langid.identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_mixing_tree(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, folder))
    return mixed.select("doc_id", "size", "source_size", "target", mixing.taken().alias("taken"))


def op10_log_bilinear_scores(spark: SparkSession, folder: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 7, 2)
    found = lm.score(documents(spark, folder), ~held_out)
    return found.withColumn("held_out", held_out)


def op11_ns_bounds_clustering(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return clustering.with_inertia(clustering.cluster(vectors, dim=64, k=8, rounds=10, scale=1024, seed=3))


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return importance.resample(documents(spark, folder), benchmark, percent=10, least_words=20)


def op13_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(documents(spark, folder), words=5, percent=80)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_syncmer_fingerprints,
        op2_cross_polytope_neighbours,
        op3_power_of_two_packing,
        op4_line_dedup,
        op5_simhash_groups,
        op6_token_files,
        op7_licence_paragraphs,
        op8_byte_cnn_language,
        op9_mixing_tree,
        op10_log_bilinear_scores,
        op11_ns_bounds_clustering,
        op12_importance_resampling,
        op13_jaccard_join,
    )
}
