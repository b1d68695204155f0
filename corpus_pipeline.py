"""Corpus pipeline over the documents table: each stage is written and read again by the next.

Language identification rejects what is no text in a known language, SimHash keeps one document of
each near-duplicate group, repeated lines and sentences are cut, sources are mixed to target weights,
and the mix is packed into sequences of power-of-two length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardiolake.llm import langid, mixing, packing, simhash, substrings
from cardiolake.llm.queries import vocabulary
from cardiolake.llm.shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; NULL texts and texts without letters go."""
    found = langid.identify(docs, F.col("lang").isNotNull())
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group: five-word Jaccard of 0.8 or more.

    Repeated rows (equal id and text) become one. Rows without an id stay where their whole group has
    none, one a text.
    """
    groups = simhash.alike(docs, words=5, least=0.8)
    firsts = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first")).distinct()
    rows = docs.select(F.struct("*").alias("doc"))
    kept = rows.join(firsts, F.col("doc.doc_id").eqNullSafe(F.col("first")), "left_semi")
    same = Window.partitionBy("doc.doc_id", F.xxhash64("doc.text")).orderBy(F.lit(1))
    return kept.withColumn("n", F.row_number().over(same)).filter("n = 1").select("doc.*")


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines and sentences that an earlier one holds; n_chars follows."""
    cut = substrings.deduplicate(docs).drop("removed")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a source that takes words of the document, with the words taken."""
    mixed = mixing.texts(docs, mixing.mix(docs))
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length, at most 1,024 ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, most=1024)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_each_group),
    ("substring dedup", no_repeated_passages),
    ("mixing sources", mixed_sources),
    ("packing", packed),
]

# A trained model and a tokenizer decide: SQL cannot state these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
