"""A corpus pipeline: documents to packed sequences, each stage one operator of vellumlake.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumlake.llm import langid, minhash, packing, rules
from vellumlake.llm.common import Scratch


#: Documents that go to a Python worker at once: each holds a whole text, and so do Spark's buffers on the way.
BATCH = 500


def modest(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most BATCH rows. Stages are run after their function has returned, so this
    stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told: without text (null or empty) or without a letter. The model is learnt
    from the languages that documents name; rows without one teach nothing and are judged. Without any named language every
    document with a letter counts as unknown and goes. Repeated rows and null doc_ids are judged row by row; ties go to the
    smallest name; an empty table stays empty; columns of whatever name stay as they are."""
    modest(spark)
    out, names = langid.predict(spark, docs, langid.fit(docs))
    return out.where(F.col(names[0]) != langid.UNKNOWN).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail base rules (null and empty texts do) or that the isolation forest rejects; without labels the
    base rules alone decide. Repeated rows and null doc_ids are judged row by row; a document on the threshold stays; an empty
    table stays empty; columns of whatever name stay as they are."""
    modest(spark)
    model = rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out, names = rules.judge(spark, docs, model)
    return out.where(F.col(names[-1])).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the smallest doc_id: five-word shingles, similarity 0.8 or
    more. Rows that share a doc_id are one document, of which the row of the smallest hash stays; null and empty texts are
    like no other and stay, and so do rows without doc_id; an empty table stays empty; columns of whatever name stay."""
    modest(spark)
    return minhash.keep_one(spark, docs, k=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces of power-of-two lengths: every row's, repeated or not; a null or empty text is its end id alone; an
    empty table gives no pieces. Columns but doc_id and text are ignored."""
    from public_tokenizers import path

    modest(spark)
    return packing.digest(packing.pack(spark, docs, path("word_bpe_49k.json")))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", packed)]

#: SQL can express neither the mixture model, nor the forest, nor the tokenizer; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder before the next one."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, name)
    return docs
