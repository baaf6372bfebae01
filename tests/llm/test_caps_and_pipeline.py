
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortspan.llm import caps, cells
from tests.llm.cases import Groups, no_docs, odd_docs

NAN, INF = float("nan"), float("inf")


def plain_links(vectors, least=0.95):
    """Links by brute force over all pairs."""
    good = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for v in map(_array, vectors)]
    n, groups = len(vectors), Groups(len(vectors))
    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = _array(vectors[i]), _array(vectors[j])
            if good[i] and good[j] and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i] += 1
                    links[j] += 1
                    groups.join(i, j)
    return links, [groups.find(k) for k in range(n)]


def _array(v):
    return v if v is None or None in v else np.array(v)


def vectors():
    pick = np.random.default_rng(7)
    centers = pick.normal(size=(6, 32))
    rows = [(c + pick.normal(scale=0.12, size=32)).tolist() for c in centers for _ in range(25)]
    rows += [pick.normal(size=32).tolist() for _ in range(60)] + [[2 * x for x in rows[0]], rows[3], rows[3], rows[3]]
    rows += [None, [], [0.0] * 32, [NAN] * 32, [INF] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 2.0], [2.0, 4.1], [-1.0, 0.0]]
    rows += [[1e300] * 32, [-0.0] + [1e300] * 31]
    return rows


@pytest.mark.parametrize("cell_rows", [4096, 8])
def test_links_and_components(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(caps, "by_cell", lambda rows, item: cells.by_cell(rows, item, cell_rows))
    rows = vectors()
    frame = spark.createDataFrame(
        [(k, v, None) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int"
    ).withColumns({c: F.lit("z") for c in ("cell", "vector", "cls", "root", "copies")})
    got = {r["vec_id"]: r for r in caps.near_duplicates(frame).collect()}
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = [None if v is None else v if None in v else (np.array(v) / 1e200).tolist() if v and abs(v[-1]) > 1e200 else v for v in rows]
        links, roots = plain_links(scaled)
    assert [got[k]["n_links"] for k in range(len(rows))] == links
    assert [got[k]["component_id"] for k in range(len(rows))] == roots
    assert [got[k]["kept"] for k in range(len(rows))] == [r == k for k, r in enumerate(roots)]
    assert caps.near_duplicates(frame.where("vec_id < 0")).count() == 0


def test_filters_recall_pairs_at_the_threshold():
    """Pairs of cosine 0.95 just so share a filter, almost always."""
    pick, code = np.random.default_rng(3), caps.ProductCode(64)
    a = pick.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = pick.normal(size=a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * noise
    shared = [bool(set(x) & set(y)) for x, y in zip(code.filters(a), code.filters(b))]
    assert np.mean(shared) >= 0.995
    first, second = code.scores(a[:5])
    for k, found in enumerate(code.filters(a[:5])):
        scores = (first[k][:, None] + second[k][None, :]).ravel()
        passed = np.flatnonzero(scores >= code.threshold)
        assert set(passed) == set(found.tolist()) or len(found) == caps.LEAST_FILTERS


def test_repeated_and_missing_ids(spark):
    same = [1.0, 2.0, 3.0]
    frame = spark.createDataFrame([(None, same), (4, same), (4, same), (9, [3.0, -1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(map(str, (tuple(r) for r in caps.near_duplicates(frame).collect())))
    assert got == sorted(map(str, [(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (9, 0, 9, True)]))


def test_stages_pass_documents_on(spark):
    docs = odd_docs(spark, clashing=False)
    stages = corpus_pipeline.STAGES
    assert len(stages) == 5
    for name, apply in stages:
        before, docs = docs, apply(spark, docs, "").persist()
        docs.count()
        if name != stages[-1][0]:
            assert docs.columns == before.columns, name
            assert docs.schema.simpleString() == before.schema.simpleString()
    assert {"doc_id", "ids", "decoded"} <= set(docs.columns) and docs.count() > 0


def test_stages_take_an_empty_table(spark):
    docs = no_docs(spark)
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, "")
        assert docs.count() == 0


def test_run_is_the_stages_in_a_row(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() <= 2 * 200 * 2
    assert out.where("n_tokens <> size(ids)").count() == 0
