"""A training-corpus pipeline: toxic documents go, one of each near-duplicate group stays, benchmark passages go, sources are mixed,
and the result is written as directly addressable token codes. Each stage is a table, read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsignal.llm import decontaminate, minhash, mixing, tokens, toxicity
from docsignal.llm.common import Scratch, read
from docsignal.ship import ship


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.7 or more. Null and empty texts score as texts without terms; repeated rows and ties are judged
    alike; all columns stay, whatever their names; an empty table stays empty."""
    machine = toxicity.train(spark, docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(spark, docs, machine)
    return scored.where(F.col(scored.columns[-1]) < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group; documents that share 0.8 of their five-word shingles are linked. Null and
    empty texts stay, as they link with nothing; of repeated rows one stays; see minhash.deduplicate for ties and null ids."""
    return minhash.deduplicate(spark, docs, minhash.NEAR_OF_100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a twentieth of their words or more in item windows, and cuts those windows out of the others; n_chars follows.
    Null and empty texts, repeated rows and other columns stay as they are; an empty benchmark changes nothing."""
    out = decontaminate.remove_spans(spark, docs, read(spark, sf_dir, "benchmark"))
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until each source has its share. Null sources are one source, null texts take nothing; rows equal in
    doc_id, source and text are taken alike; an empty table gives an empty one."""
    return mixing.apply_mix(docs, mixing.mix(spark, docs))


def token_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token codes and returns what reading them back gives: a row for each row, null and empty texts with the end id alone, in
    the order of doc_id, null first."""
    return tokens.digest(spark, docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("token_codes", token_codes)]

#: the classifier, the tokenizer and the sampling order are beyond SQL; tests/llm compares stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents; each stage's table goes once the next one is written."""
    ship(spark)
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
