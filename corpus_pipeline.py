"""The training-data pipeline: documents in, encoded clean documents out.

``STAGES`` are applied in order; each result is written as Parquet and read again as the next stage's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import bpe, decontaminate, ftrl, jaccard_join, secret_scan
from driftloom.llm.meeting import meet, unused
from driftloom.session import shared_folder

#: Documents at this toxicity or more are rejected.
TOXIC = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier calls toxic."""
    name = unused(docs.columns, "toxicity")
    scored = ftrl.with_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name)
    return scored.filter(F.col(name) < TOXIC).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one of the smallest id, and of its texts that are in the group the one of the
    least set. Rows without an id or without words are in no group and stay. Different texts of one id are in groups of their own;
    of rows that agree in id and set the least stays, column by column, so a task that runs again keeps the same one."""
    name, found = unused(docs.columns, "class"), jaccard_join.join(docs)
    grouped = found.filter("doc_id IS NOT NULL AND n_shingles > 0")
    first = grouped.groupBy("component").agg(F.min(F.struct("doc_id", "class")).alias("it")).select("it.*")
    # The kept rows of each (id, class); only the few that repeat are compared, so texts are not shuffled for the others.
    rows = grouped.groupBy("doc_id", "class").agg(F.count("*").alias("rows"))
    first = first.join(rows, ["doc_id", "class"]).select("doc_id", F.col("class").alias(name), "rows")
    often = unused(docs.columns, "rows")
    kept = meet(jaccard_join.with_class(docs, name), first.withColumnRenamed("rows", often), ["doc_id", name])
    once = kept.filter(F.col(often) == 1).select(*docs.columns)
    order = F.struct(*(F.col(c).cast("string") for c in docs.columns))
    least = kept.filter(F.col(often) > 1).groupBy("doc_id", name).agg(F.min_by(F.struct(*docs.columns), order).alias("it")).select("it.*")
    apart = jaccard_join.with_class(docs, name).filter(F.col("doc_id").isNull() | (F.col(name) == 0)).select(*docs.columns)
    return once.union(least).union(apart)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    name = unused(docs.columns, "leaks")
    found = decontaminate.with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name)
    return found.filter(F.size(name) == 0).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; ``n_chars`` follows the text."""
    return secret_scan.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    return bpe.with_tokens(docs, decoded="decoded").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontamination", decontaminated), ("secrets", without_secrets), ("bpe", encode)]

#: The classifier, the tokenizer and the randomness tests have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Between stages the rows lie in the folder that the cluster shares."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
