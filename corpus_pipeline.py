"""A corpus pipeline in five stages over ``documents``; each stage reads what the one before it wrote.

Toxicity (rejected documents go), exact dedup (owners stay), n-gram Jaccard join
(one document of each group stays), mixing to target weights (documents are
repeated at their rates; each stays once at least) and packing.

Every stage decides by row: a document's whole row travels with what is found out
about it, so rows that share an id (or have none) are documents each, and no row
comes or goes with its namesake.

Defined cases: a null text counts as empty; empty texts are clean, are one group of
exact copies, and are no near copies; of rows equal in text (white space aside) the
longest stays, then the least id (null is the largest), then the least row; of near
copies the least id stays; rows that repeat an id are judged each by their own text
(labels are found by id); an empty table gives no rows at any stage; columns of any
other name are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import exact_dedup, jaccard, mixing, packing, toxicity
from knotwork.llm.common import table, written
from knotwork.llm.queries import QUALITY_TARGETS, tokenizer


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, rows=True).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space aside): of the owner's rows the longest text, then the least."""
    owner = exact_dedup.exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_owned")).distinct()
    rows = docs.withColumn("_sha", F.sha2(exact_dedup.normalised(F.col("text")), 256))
    own = rows.join(owner, (F.col("_sha") == F.col("_owned")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    others = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
    order = F.struct(-F.length(F.coalesce("text", F.lit(""))), F.col("text"), others)
    return own.groupBy("_sha").agg(F.min_by(F.struct(*docs.columns), order).alias("_r")).select("_r.*")


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, but once at least: clean documents stay, so the targets are met by repeating.

    The fraction of a rate is settled by a hash of the id and text.
    """
    rated = mixing.mixed(docs, table(spark, sf_dir, "labels"), QUALITY_TARGETS, least=1.0, rows=True)
    part = F.pmod(F.xxhash64("row.doc_id", "row.text"), F.lit(1 << 20)) / F.lit(1 << 20)
    n = F.floor("rate").cast("int") + (part < F.col("rate") - F.floor("rate")).cast("int")
    return rated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", remove_toxic), ("exact dedup", remove_copies), ("n-gram Jaccard join", remove_near_copies), ("mixing to target weights", mix), ("packing", pack)]

#: Neither the toxicity model nor tokens can be expressed in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
