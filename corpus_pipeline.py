"""From raw documents to shuffled training shards, in five stages.

Each stage takes what its predecessor kept; ``run`` writes it as Parquet in the
shared folder and rereads it. A stage's decisions take effect: rejected, repeated
and contaminated documents are gone, mixing repeats documents, and the last stage
adds shard and slot.

All stages: a null or empty text is a document without words (the classifier judges
it, near-dedup and decontamination keep it, mixing counts one token); a null doc_id
is a key of its own, and every row is judged by its text, whatever its key. Texts are
read whole, however long. Equal rows are copies, of which near-dedup leaves one
(those without words stay). An empty table stays empty. Further columns pass through
all stages unchanged, whatever their names; a ``shard`` or ``slot`` of the input is
replaced by the last stage's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontam, mixing, near_dup, quality, sharding
from loomgraph.llm.common import plain_names, write_table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts 1 for."""
    rows, at = plain_names(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(rows, labels, at["doc_id"], at["text"], label_key="doc_id")
    good = quality.score_documents(rows, model, at["text"]).where("predicted = 1")
    return good.select(rows.columns).toDF(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 over five words): the one with the smallest doc_id."""
    rows, at = plain_names(docs)
    return near_dup.keep_rows(rows, at["doc_id"], at["text"]).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows, at = plain_names(docs)
    return decontam.clean_documents(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), at["text"]).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents at least once, those of rare sources up to mixing.MAX_REPEATS times."""
    rows, at = plain_names(docs)
    return mixing.mix_sources(rows, at["text"], at["source"]).select(rows.columns).toDF(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with shard and slot."""
    rows, at = plain_names(docs)
    out = sharding.shard_documents(rows, key=at["doc_id"], text=at["text"])
    kept = [(at[c], c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return out.select([a for a, _ in kept] + ["shard", "slot"]).toDF(*(c for _, c in kept), "shard", "slot")


STAGES = [("quality", classify), ("near_dedup", dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: No SQL expresses the trained classifier; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
