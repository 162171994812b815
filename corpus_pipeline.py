"""The corpus pipeline: five operators of ``loomgrid.llm``, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. Learned stages fit their models on the labelled
rows among their own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import packing, quality_rules, simhash, suffixdedup, toxicity
from loomgrid.llm.common import goes_at_exit, scratch_path, table
from loomgrid.llm.wordbpe import default_vocabulary

#: No SQL: learned models, tokenizers and passages of bytes are beyond it; tests hold stages against brute force.
ORACLE_SQL = None

END_ID = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the cut go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("text"))
    return quality_rules.judge(rows, rules).where("kept").select("_row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (a similarity of 0.8 of their sets of five-word shingles) the document of the
    smallest doc_id stays."""
    return simhash.keep_one(docs, simhash.similar(docs), simhash.WORDS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller doc_id has are cut from the text; n_chars follows it."""
    out = suffixdedup.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, default_vocabulary(), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("suffix_array_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        goes_at_exit(spark, path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
