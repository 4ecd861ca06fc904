"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of the stage before,
and is written as Parquet and read again. All but the last return the columns
of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordsmith.llm.common import delete, fresh, scratch, shared_dir, table
from recordsmith.llm.decontamination import decontaminate
from recordsmith.llm.line_dedup import dedup_lines
from recordsmith.llm.near_dedup import one_per_component
from recordsmith.llm.packing import pack_documents
from recordsmith.llm.quality_classifier import THRESHOLD, fit, score
from recordsmith.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is below the threshold; null and empty texts get a score like others."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    (name,) = fresh(docs, "score")
    return score(docs, model, name).where(F.col(name) >= THRESHOLD).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeats of runs of three lines, and of lines of 50 words; documents that lose every line go."""
    return dedup_lines(docs, long_words=50)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (0.8 of their five-word shingles): the smallest doc_id.

    Null texts are empty, and alike; documents are told apart by id and text where ids are null or repeated.
    """
    return one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item within a fifth of its words in edits; null and empty texts hold none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise, cut at 4096 and pack; one row for each piece, with its token ids. A null text is one piece with the end id alone."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("best_fit_packing", packing)]

#: Similarity, tokenisation and the fitted classifier are not expressible in SQL. tests/llm holds line dedup and
#: near-dedup to plain versions over all rows, decontamination to plain edit distances, packing to the library's
#: token counts, and the quality stage to its model's score, which is held to the rules one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage over what the one before it kept; only the last stage's table stays in the shared folder."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return docs
