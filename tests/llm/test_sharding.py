import zlib
from collections import defaultdict

from helpers import ALL, empty_documents, hard_documents, ids

from siteweave.llm import sharding
from siteweave.llm.sharding import combine, op9_sharding, shard


def test_combine_places_every_part_once():
    parts = [[s, 0, 0] for s in (9, 8, 7, 6, 5, 4, 3)]
    sums, moves = combine(parts)
    got = [0, 0, 0]
    for part, move in zip(parts, moves, strict=True):
        assert sorted(move) == [0, 1, 2]
        for k, s in enumerate(part):
            got[move[k]] += s
    assert got == sums and sum(sums) == 42 and max(sums) - min(sums) <= 2


def check(rows, shards=8):
    by = defaultdict(list)
    groups = defaultdict(set)
    for r in rows:
        by[r.shard].append(r)
        groups[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    for s, own in by.items():
        assert 0 <= s < shards and sorted(r.slot for r in own) == list(range(len(own)))
    return {s: sum(r.size for r in own) for s, own in by.items()}


def test_bytes_are_even_in_one_level_and_in_several(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    rows = op9_sharding(spark, "/root/testdata/sf0.01").collect()
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in rows)
    sums = check(rows)
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 0.001 * sum(sums.values())
    monkeypatch.setattr(sharding, "FAN_IN", 10)  # 100 bins, 10 bins, 1 bin
    sums = check(shard(docs).collect())
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 0.01 * sum(sums.values())


def test_hard_rows(spark):
    got = shard(hard_documents(spark)).collect()
    assert sorted((r.doc_id for r in got), key=lambda x: (x is None, x)) == ALL
    check(got)
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 4} == {(1, 0)}
    assert shard(empty_documents(spark)).count() == 0
    assert ids(shard(hard_documents(spark).where("doc_id = 2"))) == [2, 2]
