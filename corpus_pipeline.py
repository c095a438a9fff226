"""From raw documents to token ids: each stage reads what the one before wrote.

Defined results: an empty table passes through as an empty table; extra columns are carried along, whatever
their names; rows without an id stay unless their text is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.llm import bpe, decontaminate, near_copies, quality, substring_dedup
from fleetsight.llm.queries import table, tokenizer_path
from fleetsight.session import scratch_folder


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs with 0.8 of their five-word shingles in common link."""
    return near_copies.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier in the corpus; ``n_chars`` follows the text."""
    found = substring_dedup.remove_repeats(docs, with_rows=True)
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("kept_text").alias("text"))
        elif name == "n_chars":
            changed = F.length("kept_text").cast(docs.schema[name].dataType)
            columns.append(F.when(F.col("n_removed") > 0, changed).otherwise(F.col("row.n_chars")).alias(name))
        else:
            columns.append(F.col("row").getField(name).alias(name))
    return found.select(*columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with digests of the ids and of the text decoded from them."""
    return bpe.encode(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality", reject_bad),
    ("near copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("benchmark", drop_benchmark_passages),
    ("tokens", to_tokens),
]

# Training, links and merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        folder = scratch_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
