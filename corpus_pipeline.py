"""The corpus pipeline: stages over documents, each written and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` applies them to the documents of a folder. The language model is
trained, so SQL cannot express the whole; the tests hold it against plain code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.llm import bpe, decontamination, jaccard_join, language, line_dedup
from lonja.llm.queries import tokenizer_path
from lonja.runtime import release, releases_staged, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter and those rejected go."""
    model = language.train(language.training_sample(docs.select("doc_id", "text", "lang")))
    found = language.identify(docs, model)
    return docs.withColumn("_found", found).where("_found.accepted").select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; n_chars follows the text."""
    dropped = line_dedup.drop_common_lines(docs)
    if "n_chars" in docs.columns:
        counted = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
        dropped = dropped.withColumn("n_chars", counted)
    return dropped.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays."""
    found = jaccard_join.near_duplicates(docs)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(docs, benchmark)
    gone = found.where("contaminated").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The first stage is a trained model.
ORACLE_SQL = None


@releases_staged
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        before, docs = docs, stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
