"""Every query with SQL equals DuckDB's answer; the others run."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from loomtext.plans import registry


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, rel = registry.QUERIES[name](spark, sf), con.sql(registry.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    mine = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in columns]
    assert mine == sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_the_subpackage(tmp_path):
    """With both folders and the pipeline or only the folders gone, the entry imports and has all other queries."""
    root = Path(entry.__file__).resolve().parent
    code = "import __spark_entry__ as e; print(sorted(e.queries()), len(e.oracle_sql()))"
    for more in ([], ["corpus_pipeline.py"]):
        copy = tmp_path / f"copy{len(more)}"
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *more))
        told = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert told.returncode == 0, told.stderr
        assert f"{sorted(registry.QUERIES)} {len(registry.SQL)}" in told.stdout


def test_reject_rules_judge_each_pair_once_in_all_tasks(spark, sf, monkeypatch):
    """The pairs of few words are dealt to all tasks, and what comes after the judging reads only what was written."""
    from loomtext.plans import corpus_queries as Q

    held = []
    monkeypatch.setattr(Q, "materialise", lambda df, label, real=Q.materialise: held.append(df) or real(df, label))
    told = Q.reject_rules(spark, sf)
    assert [df.rdd.getNumPartitions() for df in held] == [4]
    assert told.inputFiles() and not any("conversations" in f for f in told.inputFiles())


def test_rows_without_a_near_key_are_dealt_to_all_tasks(spark):
    from pyspark.sql import functions as F

    from loomtext.operators import corpus

    rows = spark.range(400).select("id", F.when(F.col("id") >= 396, "same").alias("k"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        told = corpus.mark_duplicates(rows, F.col("k"), F.col("k"), "id").select("id", "status", F.spark_partition_id().alias("part")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.id: r.status for r in told} == {k: None if k < 396 else "kept" if k == 396 else "duplicate_exact" for k in range(400)}
    assert len({r.part for r in told if r.id < 396}) == 4
