"""The corpus pipeline: toxicity, quality, near duplicates, packing. Each stage: (spark, docs, sf_dir) -> DataFrame.

All stages but the last return rows of their input as they came, with all its columns, whatever their names. Labels are read
from sf_dir; of labelled documents only those that a stage still has teach it.

Edge cases: an empty table gives no rows; without labels of both classes nothing is told apart and every document stays.
Null and empty texts are scored as texts without a feature, are never near copies of each other, and are packed as the one
id that ends a document. Rows that repeat are scored alike, and one of them stays. Rows with a null id are scored, are
nobody's copies and are packed.

Workers, which serve all stages in turn, get few whole texts at a time and remember words for one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import neardup, packing, quality, toxicity
from pagewright.llm.common import small_batches
from pagewright.session import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity classifier rejects (score of 0.7 and more)."""
    model = toxicity.learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs if model is None else docs.where(toxicity.score_column(model, arrow=False) < toxicity.CUT)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the quality classifier rejects (score under 0.3)."""
    model = quality.learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs if model is None else docs.where(quality.score_column(model, arrow=False) >= quality.CUT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each class of near copies: that with the smallest id."""
    return neardup.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their token ids (little-endian 32-bit numbers), and the place of each in a sequence of at most
    4096 tokens. Workers remember fewer words than in packing alone, as they carry the ids too."""
    with small_batches(spark):
        return packing.pack_documents(docs, ids=True, memory=200_000)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("ngram_jaccard_join", drop_near_copies), ("best_fit_packing", pack)]
#: Fitted models, MinHash and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
