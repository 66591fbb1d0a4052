"""A training corpus from raw documents, in five stages that each write what they keep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.columns import free_name
from attestry.llm.langid import UNKNOWN, taught
from attestry.llm.leaks import item_parts, leaked_items
from attestry.llm.lines import dedup_lines
from attestry.llm.mixing import mix_to_targets
from attestry.llm.near_dedup import drop_near_duplicates
from attestry.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model is sure of; those without letters go, too."""
    found = taught(docs)
    return docs.where((found["lang"] != UNKNOWN) & (found["score"] >= LEAST_SCORE))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; what loses all its text goes."""
    name = free_name(docs, "lines")
    lines = F.col(name)
    changed = lines["n_removed"] > 0
    left = dedup_lines(docs, into=name).where(~changed | (F.trim(lines["text"]) != ""))
    text = F.when(changed, lines["text"]).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(changed, F.length(lines["text"]).cast("bigint")).otherwise(F.col("n_chars"))}
    return left.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    question, answer = item_parts(F.col("text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = leaked_items(docs, items, question=question, answer=answer)
    return docs.where(F.size(hits) == 0)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the targets, with what their probability was made of."""
    name = free_name(docs, "mixing")
    return mix_to_targets(docs, into=name).where(F.col(name)["sampled"])


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# Edit distances over all lines and similarities over all documents are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
