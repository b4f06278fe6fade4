"""From raw documents to a training mix: the stages, each a function of (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factree.llm import decontaminate, exact_dedup, jaccard, mixing, quality
from factree.llm.base import read, release, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the cut go."""
    ranking = quality.fit_labels(spark, docs, read(spark, sf_dir, "labels"), F.lit(True))
    rows = quality.scored(spark, docs, ranking)
    return rows.filter(F.col(rows.columns[-1]) >= quality.CUT).select(docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space the one with the least id stays."""
    return exact_dedup.deduplicated(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that link by five-word shingles at a similarity of 0.8 the one with the least id stays."""
    return jaccard.without_near_copies(spark, docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that a benchmark item shares are cut out; documents made of them for the most part go."""
    return decontaminate.cleaned(spark, docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: the documents and, in taken, how many of their words it reads (repeats counted)."""
    return mixing.mixed(spark, docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
]

#: Stages 1, 3 and 4 can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch(spark, stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
