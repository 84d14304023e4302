import math

import numpy as np
import pytest

from siteweave.llm import vector_duplicates
from siteweave.llm.common import roots_of
from siteweave.llm.vector_duplicates import linked, near_vectors, op5_vector_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.93):
    good = [
        (i, np.array(v, np.float64), lab) for i, v, lab in rows
        if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    links = {i: set() for i, _, _ in rows}
    for i, x, a in good:
        for j, y, b in good:
            if i != j and a == b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                links[i].add(j)
    root = {i: i for i in links}
    while True:
        new = {i: min([root[i], *(root[j] for j in links[i])]) for i in root}
        if new == root:
            return {i: (len(links[i]), root[i], i == root[i]) for i in root}
        root = new


@pytest.mark.parametrize("tile", [2048, 16])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_duplicates, "TILE", tile)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24)) * np.linspace(2, 0.2, 24)
    rows = []
    for i in range(260):
        v = centres[rng.integers(12)] + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.25])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 5])], int(rng.integers(3))))
    rng.shuffle(rows)
    rows = [(int(i), list(map(float, v)), int(lab)) for i, v, lab in rows]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)


def test_bound_loses_nothing():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 40))
    x[30:] = x[:30] + 0.3 * rng.normal(size=(30, 40))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    i, j = linked(x @ q, x @ q, x, x, 0.93, True)
    assert set(zip(i, j, strict=True)) == {(a, b) for a in range(60) for b in range(a + 1, 60) if x[a] @ x[b] >= 0.93}
    assert list(roots_of(5, np.array([3, 2]), np.array([4, 3]))) == [0, 1, 2, 2, 2]


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1),
        (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [1.0, 0.0, 0.0], 1),
        (12, [1e-30, 0.0], 1), (13, [0.0, -1.0], 2), (14, [0.0, -3.0], 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS raw", "3 AS cell", "4 AS kept")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    assert got == brute(rows)
    assert got[12] == (3, 1, False) and got[4] == (0, 4, True)
    again = spark.createDataFrame([(1, [1.0, 0.0], 1)] * 2 + [(None, [1.0, 0.0], 1)], SCHEMA)
    got = sorted((r.vec_id is None, r.n_links, r.component_id, r.kept) for r in near_vectors(again).collect())
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (True, 0, None, True)]
    assert near_vectors(df.limit(0)).count() == 0


def test_query_covers_all_rows(spark):
    sf = "/root/testdata/sf0.01"
    assert op5_vector_duplicates(spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
