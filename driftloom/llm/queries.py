"""The operators as registered queries: whole tables in, the agreed columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import bpe, decontaminate, ftrl, hilbert, jaccard_join, licences, nbsvm, quality_rules, quotations, resample, secret_scan, suffix_tree, token_alignment


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Every document encoded and decoded again: token count and digests of the ids and of the decoded text."""
    docs = bpe.with_tokens(table(spark, sf, "documents").select("doc_id", "text"), decoded="decoded")
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        hex_sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def scored(docs: DataFrame, score: str, least: float) -> DataFrame:
    """The columns that both classifiers return."""
    return docs.select(
        "doc_id",
        ftrl.held_out(F.col("doc_id")).alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= least).cast("int").alias("predicted"),
    )


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels outside the held-out fourth."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return scored(ftrl.with_toxicity(docs, table(spark, sf, "labels")), "toxicity", 0.3)


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's measures and verdict."""
    judged = quality_rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")


def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's secrets: counts by kind, a digest of the base spans and the list of all spans."""
    found = secret_scan.spans(table(spark, sf, "documents"))
    count = lambda kind: F.size(kind).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        hex_sha256(secret_scan.listed("assign", "access", "hex")).alias("base_sha256"),
        secret_scan.listed("assign", "access", "hex", "random").alias("spans"),
        count("random").alias("n_random"),
    )


def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's shingle count and its component of near copies."""
    return jaccard_join.join(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each document and benchmark item that leaks into it: where, and how alike."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.with_leaks(docs, table(spark, sf, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's quality, learnt from the labels outside the held-out fourth."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return scored(nbsvm.with_quality(docs, table(spark, sf, "labels")), "quality_score", 0.7)


def op6_quotations(spark: SparkSession, sf: str) -> DataFrame:
    """Every message without its quotes, with what it replies to and its place in the order of reply."""
    found = quotations.conversations(table(spark, sf, "conversations"))
    return found.select("conv_id", "turn", "role", "parent_turn", "root_turn", "depth", "position", "n_quotes", "text")


def op7_licences(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's licence notices: how many, which, and the closest match."""
    found = licences.with_licences(table(spark, sf, "documents").select("doc_id", "text"))
    dice = F.transform("licences", lambda m: 2.0 * m.common / (m.size + m.template_size))
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_matches"),
        F.array_join(F.array_distinct(F.transform("licences", lambda m: m.licence)), ",").alias("licences"),
        F.round(F.coalesce(F.array_max(dice), F.lit(0.0)), 6).alias("best_dice"),
    )


def op9_hilbert(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's shard and place in it, by the law of equal numbers of rows."""
    placed = hilbert.assign(table(spark, sf, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's groups of tokens between shared cuts, and what the corpus says of their links."""
    return token_alignment.aligned(table(spark, sf, "documents"))


def op12_suffix_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's log10 probability, by words alone and by the suffix tree learnt outside the held-out seventh."""
    return suffix_tree.scores(table(spark, sf, "documents"))


def op13_resample(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's weight and score towards the benchmark texts, and its rank among those drawn."""
    found = resample.resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op1_bpe": op1_bpe, "op2_quality_rules": op2_quality_rules, "op3_secret_scan": op3_secret_scan, "op4_quality": op4_quality, "op5_jaccard_join": op5_jaccard_join, "op6_quotations": op6_quotations, "op7_licences": op7_licences, "op8_decontaminate": op8_decontaminate, "op9_hilbert": op9_hilbert, "op10_toxicity": op10_toxicity, "op11_token_alignment": op11_token_alignment, "op12_suffix_tree": op12_suffix_tree, "op13_resample": op13_resample}
ORACLES = {"op7_licences": licences.oracle_sql(), "op13_resample": resample.oracle_sql()}
