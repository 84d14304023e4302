import itertools
import random

import numpy as np
from conftest import plan_of
from helpers import ALL, empty_documents, hard_documents, ids

from siteweave.llm import common
from siteweave.llm.common import connected, likely, parted, shingles_of, words_of
from siteweave.llm.near_duplicates import HASHES, LEAST_SHARE, minhashes, near_duplicates, without_near_duplicates


def brute(rows):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {i: set(shingles_of(words_of(t.encode() if t else None)).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_groups_of_edited_copies_and_a_common_passage(spark):
    """Groups whose members link through others only, and texts that share a long passage."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(50_000)}"
    passage = [word() for _ in range(60)]
    rows, n = [], 0
    for group in range(6):
        base = [word() for _ in range(rng.choice([40, 120, 300]))]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    for _ in range(150):
        rows.append((n, " ".join([word() for _ in range(rng.randrange(5, 80))] + passage)))
        n += 1
    rng.shuffle(rows)
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    want = brute(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_minhashes_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    a, b = x[:350], x[50:]  # 300 of 400
    share = (minhashes(a) == minhashes(b)).mean()
    assert 0.6 < share < 0.9
    assert LEAST_SHARE * 0.75 * HASHES < 0.75 * HASHES - 5.5 * (HASHES * 0.75 * 0.25) ** 0.5


def test_connected_follows_long_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1300)] + [(1299, 900)]
    rng = random.Random(1)
    rng.shuffle(chain)
    got = {r.node: r.component for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{k: 900 for k in [900, *range(1000, 1300)]}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hard_rows(spark):
    docs = hard_documents(spark)
    got = near_duplicates(docs)
    assert ids(got) == ALL
    by = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    assert [by[i].component_id for i in range(1, 12)] == [1, 1, 1, 4, 5, 6, 7, 8, 8, 10, 7]
    assert by[4].n_shingles == by[5].n_shingles == by[6].n_shingles == 0 and by[8].n_shingles == 1
    assert all(r.component_id is None and r.kept for r in got.where("doc_id is null").collect())
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns and ids(kept) == [1, 4, 5, 6, 7, 8, 10, None, None]
    assert ids(without_near_duplicates(docs.where("doc_id = 2"))) == [2]
    assert near_duplicates(empty_documents(spark)).count() == 0
    assert without_near_duplicates(empty_documents(spark)).count() == 0


def test_texts_of_one_id_are_each_on_their_own(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (5, b), (5, c), (7, c + " more"), (8, a), (8, a), (9, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (5, 1, False), (5, 5, True), (7, 5, False), (8, 1, False), (8, 1, False), (9, 5, False)]
    left = without_near_duplicates(docs)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, a), (1, b), (5, c)]
    # two texts of the id that stays, alike: one of them
    twins = docs.where("doc_id = 7").unionByName(spark.createDataFrame([(7, c)], "doc_id long, text string"))
    assert near_duplicates(twins).where("kept").count() == 2 and without_near_duplicates(twins).count() == 1


def test_one_text_on_a_third_of_the_rows(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    rows = [(k, words(0) if k % 3 == 0 else words(k)) for k in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = near_duplicates(docs).where("component_id = 0").count()
    assert got == 1_000 and without_near_duplicates(docs).count() == 2_001


def test_a_part_of_the_rows_is_found_and_few_others(spark, monkeypatch):
    rows = spark.range(40_000).selectExpr("IF(id % 1000 = 0, NULL, id) AS id", "string(id) AS text")
    members = spark.range(0, 20_000, 4)
    found, others = parted(rows, members, ["id"])
    wanted = {k for k in range(0, 20_000, 4) if k % 1000}
    assert {r.id for r in found.collect()} == wanted and found.count() == len(wanted)
    assert sorted(int(r.text) for r in others.collect()) == sorted(set(range(40_000)) - wanted)
    assert likely(rows, members, ["id"]).where("likely").count() < len(wanted) + 40_000 / 10
    assert likely(rows, members.limit(0), ["id"]).where("likely").isEmpty()
    monkeypatch.setattr(common, "MOST_BITS", 1 << 15)  # too few bits: more is joined, nothing else changes
    found, others = parted(rows, members, ["id"])
    assert found.count() == len(wanted) and others.count() == 40_000 - len(wanted)


def test_texts_are_not_shuffled_to_be_left_out(spark):
    """However many documents go, the texts of those that stay are neither sorted nor joined."""
    rows = [(k, f"one two three four five six {k % 50} {'x' * (k % 50)}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = without_near_duplicates(docs)
        plan = plan_of(kept.select("doc_id", "text"), "simple")
        sides = plan.split("Union")[1]
        first = sides.split("Exchange")[0] if "Exchange" in sides else sides
        assert "BroadcastHashJoin" in first and "SortMergeJoin" not in first
        assert ids(kept) == ids(near_duplicates(docs).where("kept"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
