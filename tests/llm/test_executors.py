"""What executors see: no copy of the package, and folders by the names that Spark knows them by."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortspan.llm import langid, mixing, simhash, substrings, tokenfiles
from tests.llm.cases import SCHEMA, odd_docs, phrase

REPO = str(Path(__file__).resolve().parents[2])

ELSEWHERE = """
import sys
sys.path.insert(0, {repo!r})
from __spark_entry__ import queries
from cohortspan.session import local_session

spark = local_session(2)
registered = queries()
for name in ("op4_logbilinear", "op5_langid", "op11_lines", "op12_resampling", "op13_interactions"):
    assert registered[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    script = tmp_path / "job.py"
    script.write_text(ELSEWHERE.format(repo=REPO))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600
    )
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_folders_are_named_as_spark_finds_them(spark, tmp_path, monkeypatch):
    assert tokenfiles.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert tokenfiles.qualified(spark, f"file://{tmp_path}") in (f"file:{tmp_path}", f"file://{tmp_path}")
    for name in (f"file:{tmp_path}/a", f"file://{tmp_path}/a"):
        store, path = tokenfiles._store(name)
        assert path == f"{tmp_path}/a" and store.type_name == "local"
    asked = []

    class Stores:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)
            return None, uri

    monkeypatch.setattr(tokenfiles.fs, "FileSystem", Stores)
    for name in ("s3a://bucket/x", "s3n://bucket/x", "s3://bucket/x", "hdfs://host:1/x"):
        tokenfiles._store(name)
    assert asked == ["s3://bucket/x"] * 3 + ["hdfs://host:1/x"]


def test_a_default_store_decides_where_folders_lie(spark, tmp_path):
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    hadoop.set("fs.defaultFS", "viewfs://store/")
    hadoop.set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    try:
        assert tokenfiles.qualified(spark, "/in/x") == "viewfs://store/in/x"
    finally:
        hadoop.set("fs.defaultFS", before)


@pytest.mark.parametrize("apply", [
    simhash.keep_one, mixing.mixed_documents, substrings.without_repeats, lambda docs: langid.keep_told(docs, 0.0),
], ids=["near copies", "mix", "passages", "language"])
def test_filters_return_documents_whatever_their_columns_are_called(spark, apply):
    plain, clashing = odd_docs(spark, clashing=False), odd_docs(spark)
    out = apply(clashing)
    assert out.columns == clashing.columns
    want, got = (sorted(map(str, df.select("doc_id", "text", "source").collect())) for df in (apply(plain), out))
    assert got == want
    assert out.where("rows <> 'clash' OR `__key` <> 'clash'").count() == 0


def test_language_rejects_rows_one_by_one_and_removes_its_tables(spark, monkeypatch):
    rows = [(k, phrase(k, 40), "xx", "a", None) for k in range(6)] + [(9, "1234 !!", None, "a", None), (10, None, "xx", "a", None)]
    rows += [(3, phrase(3, 40), "xx", "a", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = langid.keep_told(docs, 0.5)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 3, 4, 5]
    assert kept.select(F.max("text")).first()[0] is not None
