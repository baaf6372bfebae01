import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortspan.llm import cells, simhash
from tests.llm.cases import LOWER, SCHEMA, Groups, no_docs, odd_docs, odd_rows, words


def plain_fingerprint(text):
    found = words((text or "").translate(LOWER))
    shingles = [" ".join(found[i:i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    groups = Groups(len(prints))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                groups.join(i, j)
    least = {}
    for k, doc in enumerate(ids):
        root = groups.find(k)
        least[root] = min((x for x in (least.get(root), doc) if x is not None), default=None)
    return [least[groups.find(k)] for k in range(len(ids))]


def test_odd_documents(spark):
    rows = odd_rows()
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = plain_components(prints, [r[0] for r in rows])
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=key) == sorted(
        ((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, want)), key=key
    )


def test_spark_hashes_shingles_alike(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("of the é")).alias("h")).first()["h"]
    assert got % 2**64 == xxhash.xxh64_intdigest("of the é".encode(), 42)


@pytest.mark.parametrize("cell_rows", [4096, 16])
def test_grid_join_finds_every_close_pair(spark, monkeypatch, cell_rows):
    """A crowd of near fingerprints, chains and far ones, with cells split and whole."""
    monkeypatch.setattr(cells, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(simhash, "by_cell", lambda rows, item: cells.by_cell(rows, item, cell_rows))
    pick = random.Random(5)
    flip = lambda x, n: x ^ sum(1 << b for b in pick.sample(range(64), n))
    center = pick.getrandbits(64)
    prints = [flip(center, pick.randrange(1, 5)) for _ in range(150)]
    prints += [pick.getrandbits(64) for _ in range(150)]
    prints += [flip(pick.choice(prints[150:]), 3) for _ in range(150)]
    prints = list(dict.fromkeys(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["root"] for r in simhash.fingerprint_components(frame).collect()}
    names = plain_components(prints, list(range(len(prints))))
    roots = {}
    for name, fp in zip(names, signed):
        roots[name] = min(roots.get(name, fp), fp)
    assert all(got.get(fp, fp) == roots[name] for name, fp in zip(names, signed))


def test_manhattan_distance_never_exceeds_bit_distance():
    random_prints = np.random.default_rng(1).integers(0, 2**64, 2000, np.uint64)
    a, b = random_prints[:1000], random_prints[1000:]
    bound = np.bitwise_count(simhash.unary(a) ^ simhash.unary(b))
    assert (bound <= np.bitwise_count(a ^ b)).all()


def test_one_row_of_each_component_stays(spark):
    kept = simhash.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    rows = odd_rows()
    components = {str(c) for c in plain_components([plain_fingerprint(r[1]) for r in rows], [r[0] for r in rows])}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(components)
    ids = [(None, "a b c d", None, None, None), (None, "a b c d", None, None, None)]
    assert simhash.keep_one(spark.createDataFrame(ids, SCHEMA)).count() == 1


def test_empty_table_and_wider_distance(spark):
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    with pytest.raises(ValueError, match="up to 3"):
        simhash.near_duplicates(odd_docs(spark), most_bits=4).count()
