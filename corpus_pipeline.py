"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.llm import neardup, packing, quality, rules, suffix
from fotolith.llm.common import Scratch, fresh, prepare, table
from fotolith.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    prepare(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out = fresh(docs, "score")
    return quality.score(docs, model, out=out).where(F.col(out) >= quality.ACCEPT).select(docs.columns)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failing lines."""
    prepare(spark)
    return with_length(rules.clean(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    prepare(spark)
    return neardup.keep_one(docs, Scratch(spark, "neardup"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document with a smaller id holds already.

    Bytes of a character that a removed passage cuts in two go with it.
    """
    prepare(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    aside = {c: f"carried_{i}" for i, c in enumerate(others)}  # no name of the operator's own results
    named = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(aside[c]) for c in others))
    made = suffix.dedup(named, Scratch(spark, "substrings"), carry=list(aside.values()), as_text=True)
    back = {"doc_id": "doc_id", "text": "kept", **aside}
    return with_length(made.select(*(F.col(back[c]).alias(c) for c in docs.columns)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 1024 tokens."""
    prepare(spark)
    made = packing.pack(docs, vocabulary("byte_bpe_50k.json"), Scratch(spark, "sequences"))
    return made.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality classifier", quality_stage),
    ("quality rules", rules_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier, the fingerprints or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    prepare(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
