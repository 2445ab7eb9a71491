"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

1. quality rules drop the documents that fail; 2. line dedup removes repeated three-line passages from the texts; 3. SimHash
near-dedup, with the exact links of five-word shingles, keeps one document of each group of near copies; 4. benchmark
decontamination drops documents that hold a passage of a benchmark item; 5. SentencePiece encoding gives what is left as ids,
with the next best segmentations.

All stages but the last return the columns of documents. ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territory.llm import decontamination, line_dedup, piece_codec, quality_rules, simhash_dedup
from territory.llm.common import scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 6: the documents that pass every rule."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 9: every document, later occurrences of repeated passages removed from its text."""
    out = line_dedup.dedup(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 4, and five-word Jaccard similarity of 0.8: one document of each group of near copies, the one of the smallest id."""
    return simhash_dedup.keep_one(docs, similar=True)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 10: the documents without a benchmark passage."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 3: (doc_id, n_pieces, score, ids, nbest, round_trip) of every document."""
    return piece_codec.encode(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_copies), ("benchmark decontamination", benchmarks), ("piece encoding", pieces)]

#: SQL has no SentencePiece lattice and no SimHash by set bits at bearable cost; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage makes is written below the shared checkpoint folder, read again, and deleted when
    the driver ends."""
    base = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
