"""From raw documents to packed training windows, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``, whatever else these have beside them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import common, packing, quality, simhash, suffix_dedup, toxicity

TOXIC = 0.5
GOOD = 0.3
TOKENIZER = "byte_bpe_50k.json"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under TOXIC. Null and empty texts have the base score, equal texts equal scores; repeated
    rows and null ids stay as they are; without labels of both kinds the share of toxic rows decides on all."""
    score = common.free_name(docs, "toxicity")
    return toxicity.score_toxicity(docs, _labels(spark, sf_dir), name=score).where(F.col(score) < TOXIC).drop(score)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of GOOD and more; edge cases as in the stage before."""
    score = common.free_name(docs, "quality")
    return quality.score_quality(docs, _labels(spark, sf_dir), name=score).where(F.col(score) >= GOOD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a similarity of 0.8 or more, the one with
    the smallest id. Null and empty texts and those without words are copies of each other; null ids come last; of rows
    equal in id and text one stays."""
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that they, or documents with smaller ids, have before. Null and
    short texts stay as they are; documents of which nothing is left go; null ids come last."""
    return suffix_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows of 1,024 ids. Null and empty texts have the end id only; repeated rows are packed one by one."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("simhash", drop_near_copies),
    ("repeats", cut_repeats),
    ("packing", pack),
]

#: The models, links and windows of the stages can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, before = common.Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = out.save(stage(spark, docs, sf_dir), name)
        if before:
            out.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
