"""Batches are worked on in pieces, so a worker's memory does not follow the size of a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from siteweave.llm import common, near_duplicates, toxicity
from siteweave.llm.common import PIECE_BYTES, pieces


def texts(rows: int, words: int) -> pa.Array:
    return pa.array([" ".join(f"w{(r * 31 + k) % 997}x{k}" for k in range(words)) for r in range(rows)])


def test_pieces_are_the_batch_again():
    long = "x" * (3 * PIECE_BYTES)
    for column in ([], [None], ["", None, "a"] * 9, ["a", long, "b", None, long, long], ["abc" * 1000] * 2000):
        for kind in (pa.string(), pa.large_string()):
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(column)), pa.int64()), pa.array(column, kind)], names=["id", "text"])
            got = list(pieces(batch, 1))
            assert len(got) >= 1 and pa.Table.from_batches(got).combine_chunks().equals(pa.Table.from_batches([batch]))
            assert all(p.num_rows for p in got) or not column
            for piece in got:
                sizes = [len(t or "") for t in piece.column(1).to_pylist()]
                assert sum(sizes[1:]) <= PIECE_BYTES
    # the last case, 6 MB of texts
    assert len(got) >= 6


def test_what_a_batch_makes_is_made_in_pieces(monkeypatch):
    monkeypatch.setattr(common, "PIECE_BYTES", 1 << 16)
    column = texts(300, 300)
    ids, mark = pa.array(range(300), pa.int64()), pa.array([0] * 300, pa.int64())
    two = pa.RecordBatch.from_arrays([ids, column], names=["id", "text"])
    three = pa.RecordBatch.from_arrays([ids, column, mark], names=["id", "text", "mark"])
    for run in (toxicity.feature_rows([two]), near_duplicates.set_rows(5)([two]), near_duplicates.sketch_rows(5)([three])):
        made = [(out.num_rows, out.nbytes) for out in run]
        # ten of 64 KB each, where one batch made one batch
        assert sum(n for n, _ in made) == 300 and len(made) >= 9 and max(n for n, _ in made) <= 40


def test_features_are_found_among_the_known_without_a_python_number_each():
    rng = np.random.default_rng(5)
    known = np.sort(rng.choice(50_000, 6000, replace=False)).astype(np.int64)
    lists = [rng.choice(60_000, n, replace=False) for n in (0, 1, 900, 0, 5, 0)]
    want = [[k for k, v in enumerate(known.tolist()) if v in set(x.tolist())] for x in lists]
    batch = pa.array(lists, pa.list_(pa.int64()))
    assert toxicity.places(batch, known).to_pylist() == want
    assert toxicity.places(batch.slice(2, 3), known).to_pylist() == want[2:5]
    assert toxicity.places(batch, known[:0]).to_pylist() == [[]] * 6
    assert toxicity.places(batch.slice(0, 0), known).to_pylist() == []
    wide = pa.array([rng.integers(0, 1 << 40, 900) for _ in range(2000)], pa.list_(pa.int64()))
    tracemalloc.start()
    toxicity.places(wide, known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * wide.nbytes


def test_arrow_batches_are_bounded_by_bytes_unless_the_user_bounds_them(spark, tmp_path):
    key = common.ARROW_BYTES[0]
    before = spark.conf.get(key, None)
    path = str(tmp_path / "documents.parquet")
    spark.range(6000, numPartitions=1).selectExpr("id AS doc_id", "repeat(md5(string(id)), 60) AS text").coalesce(1).write.parquet(path)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    try:
        spark.conf.unset(key)
        got = common.table(spark, str(tmp_path), "documents").mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 6000 and max(r.bytes for r in got) < 5 << 20
        spark.conf.set(key, "8m")
        common.table(spark, str(tmp_path), "documents")
        assert spark.conf.get(key) == "8m"
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)
