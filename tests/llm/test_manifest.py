import hashlib
import zlib

import pytest
from helpers import ALL, empty_documents, hard_documents, ids
from pyspark.sql import functions as F

from siteweave.llm import manifest as module
from siteweave.llm.manifest import (
    COLUMNS, document_proofs, folded, leaf_of, manifest, numbered, op13_manifest, proofs, read_manifest, write_manifest,
)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    """(doc_id, leaf) -> the siblings and sides of each of its leaves, and both roots; rows are
    (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(*row), row[0]))
    for own in trees.values():
        own.sort(key=lambda x: x[:3])
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    levels = {n: levels_of([x[2] for x in trees[n]]) for n in names}
    top = levels_of([levels[n][-1][0] for n in names])
    out = []
    for at, name in enumerate(names):
        for pos, (_, _, own, doc) in enumerate(trees[name]):
            path = []
            for part, k in ((levels[name], pos), (top, at)):
                for level in part[:-1]:
                    path.append((bool(k & 1), level[k ^ 1] if k ^ 1 < len(level) else None))
                    k >>= 1
            out.append((doc, own, path, levels[name][-1][0], top[-1][0]))
    return out


def key(row):
    return repr(row)


@pytest.mark.parametrize("step", [8, 2, 1])
def test_proofs_equal_brute_force(spark, monkeypatch, step):
    monkeypatch.setattr(module, "STEP", step)
    rows = [(k, f"s{k % 3}", ["en", "de", None, "Ü", "one"][min(k * k % 7, 4) if k else 4], k, f"t é {k}") for k in range(150)]
    rows += [(5, "s", "en", None, None)] * 2 + [(None, None, None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = document_proofs(docs, COLUMNS)
    fold = folded(F.col("leaf"), F.col("steps")).alias("fold")
    got = found.select("*", fold).collect()
    assert all(r.fold == r.root for r in got)
    mine = [(r.doc_id, r.leaf, [(s.left, s.hash) for s in r.steps], r.subroot, r.root) for r in got]
    assert sorted(mine, key=key) == sorted(brute(rows), key=key)


def test_a_changed_row_or_step_is_noticed(spark):
    docs = spark.range(40).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"),
        F.lit(1).cast("long").alias("n_chars"), F.lit("t").alias("text"),
    )
    found = document_proofs(docs, COLUMNS)
    wrong = F.transform("steps", lambda s, i: F.when(i == 3, s.withField("hash", F.lit("0" * 64))).otherwise(s))
    assert found.where(folded(F.col("leaf"), wrong) == F.col("root")).count() == 0
    assert found.where(folded(F.lit("0" * 64), F.col("steps")) == F.col("root")).count() == 0


def test_query_says_verified_of_what_was_not_tampered_with(spark):
    rows = op13_manifest(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in rows)


def test_numbers_go_over_partitions(spark):
    rows = spark.range(1_000).select((F.col("id") % 2).alias("tree"), F.col("id").alias("v")).repartition(6)
    got = numbered(rows, [F.col("v")]).collect()
    assert all(r.pos == r.v // 2 and r.nodes == 500 for r in got)


def test_stored_manifest_gives_the_same_proofs(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    leaves = docs.select(F.col("lang").alias("tree"), "doc_id", leaf_of(docs, COLUMNS).alias("hash"))
    levels, tops = manifest(leaves, [F.col("doc_id")])
    assert len(levels) <= 3 and levels[1].count() < leaves.count() / 20
    write_manifest(levels, tops, f"{tmp_path}/m")
    again = proofs(*read_manifest(spark, f"{tmp_path}/m"))
    assert again.exceptAll(proofs(levels, tops)).count() == 0 and again.count() == leaves.count()


def test_hard_rows(spark):
    hard = hard_documents(spark)
    got = document_proofs(hard, COLUMNS)
    assert ids(got) == ALL
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in hard.collect()]
    mine = [(r.doc_id, r.leaf, [(s.left, s.hash) for s in r.steps], r.subroot, r.root) for r in got.collect()]
    assert sorted(mine, key=key) == sorted(brute(rows), key=key)
    assert document_proofs(empty_documents(spark), COLUMNS).count() == 0
    assert document_proofs(hard.where("doc_id = 1"), COLUMNS).first().steps == []
