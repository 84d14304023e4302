import os
from collections import Counter

from helpers import ALL, empty_documents, hard_documents, ids

from siteweave.llm import common
from siteweave.llm.mixture import cycle_5_2_1, measured, mix, mixed_documents, op1_mixture, targets_of

SF = "/root/testdata/sf0.01"


def test_targets_reshare_the_excess():
    assert targets_of([("a", 10), ("b", 100), ("c", 100)], [5, 2, 1], 105.0, 2.0) == [20.0, 170 / 3, 85 / 3]
    assert targets_of([("a", 10), ("b", 0)], [5, 2], 50.0, 2.0) == [20.0, 0.0]
    assert targets_of([], [], 0.0, 2.0) == []


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    rows = op1_mixture(spark, SF).toPandas()
    again = op1_mixture(spark, SF).toPandas()
    key = lambda df: sorted(map(tuple, df.to_numpy().tolist()))
    assert key(rows) == key(again)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").toPandas()
    size = {r.doc_id: len(r.text.encode().split()) for r in docs.itertuples()}
    source = dict(zip(docs.doc_id, docs.source, strict=True))
    assert all(r.size == size[r.doc_id] and r.taken <= 2 * r.size for r in rows.itertuples())
    sums = Counter()
    for i, n in size.items():
        sums[source[i]] += n
    names = sorted(sums, key=lambda s: s.encode())
    want = dict(zip(names, targets_of([(s, sums[s]) for s in names], cycle_5_2_1(names), 1.5 * sum(sums.values()), 2.0), strict=True))
    taken = Counter()
    for r in rows.itertuples():
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.source_size == sums[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    most = max(size.values())
    assert all(abs(taken[s] - want[s]) <= most for s in names)


def test_smaller_budgets_are_nested(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = lambda share: {r.doc_id: r.copies for r in mix(docs, lambda s: [1.0] * len(s), share).collect()}
    low, high = copies(0.3), copies(0.9)
    assert all(low[i] <= high[i] for i in low) and sum(low.values()) < sum(high.values())


def test_hard_rows(spark):
    docs = hard_documents(spark)
    got = mix(docs, cycle_5_2_1, 1.5)
    assert ids(got) == ALL
    assert {r.taken for r in got.where("doc_id in (4, 5, 6)").collect()} == {0}
    out = mixed_documents(docs, cycle_5_2_1, 1.5)
    assert out.columns == docs.columns
    want = Counter()
    for r in got.collect():
        want[r.doc_id] += r.copies
    assert Counter(ids(out)) == Counter({k: v for k, v in want.items() if v})
    assert mix(empty_documents(spark), cycle_5_2_1, 1.5).count() == 0
    assert mixed_documents(empty_documents(spark), cycle_5_2_1, 1.5).count() == 0


def test_equals_sorting_by_hash_and_adding_up(spark):
    """Of each source the rows of the smallest hashes go in once more, until the budget ends;
    the row where it ends goes in if that brings the words nearer to it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = measured(docs, "doc_id", "text", "source").collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: s.encode())
    sizes = [(s, sum(r.size for r in by[s])) for s in names]
    for share in (0.4, 1.5):
        targets = targets_of(sizes, cycle_5_2_1(names), share * sum(n for _, n in sizes), 2.0)
        want = {}
        for (name, size), target in zip(sizes, targets, strict=True):
            times, left = int(target // size), target - target // size * size
            for r in sorted(by[name], key=lambda r: r.h):
                once_more = r.size <= left or 2 * left > r.size
                want[r.doc_id] = (times + once_more) * r.size
                left = left - r.size if r.size <= left else -1
        got = {r.doc_id: r.taken for r in mix(docs, cycle_5_2_1, share).collect()}
        assert got == want


def test_saved_tables_go_when_asked(spark):
    before = len(common.SAVED)
    rows = common.saved(spark.range(5).toDF("x"))
    path = common.SAVED[-1]
    assert rows.count() == 5 and os.path.isdir(path.removeprefix("file:"))
    common.remove_saved(spark, before)
    assert not os.path.exists(path.removeprefix("file:")) and len(common.SAVED) == before
