"""The corpus pipeline: five stages over `documents`, each by one operator of the llm subpackage.

A stage takes what the one before kept, written as Parquet and read again. All but the last give the columns of
`documents`: their decisions are the rows that are left. Nulls, ties and repeated rows are treated as the operators'
docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import bpe, decontam, langid, neardup, quality
from meridia.llm.queries import WORD_BPE, table
from meridia.llm.textkit import dropped, free_name, shared_folder

#: Documents with a smaller chance of label 1 go.
LEAST_QUALITY = 0.5
#: Words of the shingles, and percent of similarity, of the near-duplicate stage.
SHINGLE_WORDS, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are too far from all languages of `docs`, and those without a letter."""
    names = tuple(free_name(x, docs.columns) for x in ("lang_pred", "lang_score", "rejected"))
    return langid.predict(docs, langid.fit(docs), columns=names).where(~F.col(names[2])).select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from the labelled ones among `docs`."""
    score = free_name("quality_score", docs.columns)
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), column=score)
    return found.where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return neardup.first_of_each(docs, neardup.find(docs, words=SHINGLE_WORDS, percent=PERCENT))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which an item of `benchmark` leaks."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded text, and the ids of each document."""
    return bpe.round_trip(docs, WORD_BPE, with_ids=True)


STAGES = [("language", language), ("quality", good), ("near-duplicates", distinct), ("decontamination", decontaminated), ("tokens", tokens)]

#: SQL can't express trained models, tiling or BPE; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            schema = docs.schema
            docs.write.mode("overwrite").parquet(f"{folder}/{k}")
            docs = spark.read.schema(schema).parquet(f"{folder}/{k}")
            dropped(spark, *([f"{folder}/{k - 1}"] if k else []))
    return docs
