import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortspan.llm.components import components, star
from cohortspan.llm.prefix import running_totals
from cohortspan.llm.texts import Remembered, count_words, runs, slices, split_words
from tests.llm.cases import Groups, odd_docs, odd_rows, words


def test_words_are_counted_alike_everywhere(spark):
    got = odd_docs(spark).select(count_words(F.col("text")).alias("n")).collect()
    want = [len(words(r[1])) for r in odd_rows()]
    assert [r["n"] for r in got] == want
    found, counts = split_words(pa.array([r[1] for r in odd_rows()]))
    assert counts.tolist() == want
    assert found.to_pylist() == [w for r in odd_rows() for w in words(r[1])]


def test_slices_keep_rows_and_bound_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c" * 10, "d"]})
    parts = list(slices(iter([batch]), most_bytes=20))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert max(sum(len(x or "") for x in p.column("text").to_pylist()) for p in parts) == 100
    assert list(slices(iter([batch.slice(0, 0)]))) == []


def test_runs_of_no_rows():
    assert [x.tolist() for x in runs(np.array([], int))] == [[], []]
    assert [x.tolist() for x in runs(np.array([1, 1, 2]), np.array([0, 0, 0]))] == [[0, 2], [2, 3]]


def test_remembered_forgets_the_later_half():
    made = []
    kept = Remembered(lambda k: made.append(k) or -k, 4)
    assert [kept[k] for k in (1, 2, 3, 4, 5, 1, 3)] == [-1, -2, -3, -4, -5, -1, -3]
    assert made == [1, 2, 3, 4, 5, 3]


def test_running_totals_over_ties_and_nulls(spark):
    rows = [(k, k % 3 if k % 5 else None, k) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, g int, v long")
    got = running_totals(df, [F.col("g").asc_nulls_last(), F.col("id")], {"before": F.col("v"), "rank": F.lit(1)})
    at, n = 0, 0
    result = {r["id"]: (r["before"], r["rank"]) for r in got.collect()}
    for k, g, v in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        assert result[k] == (at, n)
        at, n = at + v, n + 1
    assert running_totals(df.where("id < 0"), [F.col("id")], {"before": F.col("v")}).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(5, 5), (3, 2), (2, 3), (-9, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    groups = Groups(200)
    for a, b in edges:
        groups.join(a + 10, b + 10)
    got = {r["node"]: r["root"] for r in found.collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: groups.find(x + 10) - 10 for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_star_links_each_item_to_its_first():
    moved, root = star(np.array([4, 1, 2]), np.array([2, 0, 5]), 6)
    assert dict(zip(moved.tolist(), root.tolist())) == {1: 0, 4: 2, 5: 2}
