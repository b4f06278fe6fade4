import subprocess
import sys
from pathlib import Path

import brute
import corpus_pipeline
import pytest
from factree.llm import exact_dedup, jaccard, quality
from factree.llm.base import scratch
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, DATA)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        before = scratch(spark, after, "stage")
        sizes.append(before.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert before.filter("taken <= 0").isEmpty()


def test_near_duplicates_of_the_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    corpus = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute.components(corpus, 5, 80)
    assert sorted(map(tuple, jaccard.near_classes(spark, docs, 5, 80).select("doc_id", "n", "component_id").collect())) == want
    assert corpus_pipeline.near_duplicates(spark, docs, DATA).count() == len({c for _, _, c in want})


def test_rejected_documents_go(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, DATA).join(labels, "doc_id")
    bad, good = (labels.join(docs, "doc_id").filter(F.col("quality") == q).count() for q in (0, 1))
    assert kept.filter("quality = 1").count() >= 0.95 * good and kept.filter("quality = 0").count() <= max(1, 0.2 * bad)
    assert quality.CUT == 0.3 and exact_dedup.deduplicated(spark, docs).count() <= docs.count()


@pytest.mark.parametrize("code", ["import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"])
def test_the_entry_imports_without_a_session(code):
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout.split()[0]) > 100


def test_the_entry_stands_without_these_operators(tmp_path):
    import shutil

    for part in ("factree", "__spark_entry__.py"):
        source = REPO / part
        shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) > 90
