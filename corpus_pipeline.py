"""The training-data pipeline: quality, near duplicates, repeated passages, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs`` (extra ones included, whatever their names); empty tables pass
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import mixing, packing, quality, repeats, simhash
from keystrata.llm.common import fresh, stash


#: What the suffix-array stage removes: runs of so many words that repeated strings of so many bytes cover.
REPEATED_WORDS, REPEATED_BYTES = 50, 200


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns other than ``used`` under names that no operator gives, and what brings their names back."""
    names = {c: c if c in used else n for c, n in zip(docs.columns, fresh(docs, *(f"kept_{k}" for k in range(len(docs.columns)))))}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows, back = aside(docs, "doc_id", "text")
    return quality.classify(rows, labels).where("predicted = 1").select(*back)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return simhash.keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of ``REPEATED_WORDS`` go; documents stay, if need be empty, with ``n_chars`` brought up to date."""
    rows, back = aside(docs, "doc_id", "text")
    out = repeats.remove_repeats(rows, length=REPEATED_BYTES, words=REPEATED_WORDS, as_text=True).withColumnRenamed("kept", "text").select(*back)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them, up to twice."""
    rows, back = aside(docs, "doc_id", "text", "source")
    mixed = mixing.mix(rows)
    (s_copy,) = fresh(mixed, "copy")
    times = F.when(F.col("size") > 0, F.col("epochs") + F.col("picked").cast("long")).otherwise(0).cast("int")
    return mixed.withColumn(s_copy, F.explode(F.array_repeat(F.lit(0), times))).select(*back)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2,048 tokens. Workers also serve the other stages: little memory."""
    items = stash(packing.tokenize(docs.select("doc_id", "text"), packing.word_tokenizer(), with_ids=False, kept=100_000, block=1 << 20), "pieces")
    return packing.pack(items, order=("doc_id", "piece", "ids_crc32"))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Trained weights, fingerprints and tokenizers are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
