"""Exact duplicates by compressed radix tries whose terminals store the owner of a text."""

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from siteweave.llm.common import saved, table, texts_of

#: Bytes of labels and nodes that a trie holds before it spills subtrees.
TRIE_BYTES = 128 << 20
#: What a node costs besides its label.
NODE_BYTES = 300
#: Bytes of output that a task gathers before it hands them on.
OUT_BYTES = 16 << 20
#: A text that this part of all rows or more share is hot. There are SHARE such texts at
#: most, which bounds what is broadcast.
SHARE = 1000

SPILL = -1


class Owner(NamedTuple):
    text: bytes
    owner: int | None
    copies: int


def better(a: int | None, b: int | None, keep: str) -> int | None:
    """The identifier that stays; a null one only where there is no other."""
    if a is None or b is None:
        return a if b is None else b
    return max(a, b) if keep == "largest" else min(a, b)


def agreed(label: bytes, key: bytes, at: int) -> int:
    """How many first bytes of the label the key has from `at` on, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        half = (low + high + 1) // 2
        if key.startswith(label[low:half], at + low):
            low = half
        else:
            high = half - 1
    return low


class Trie:
    """A compressed radix trie of byte strings with owners and counts at its terminals.

    A node is [label, children by first byte, owner, copies]; copies is 0 where no string
    ends, and SPILL where the subtree has been handed on: owner then is the name of the
    subtree, and strings that get there are handed on as well.
    """

    def __init__(self, keep: str, most: int):
        self.keep, self.most = keep, most
        self.root: list = [b"", {}, None, 0]
        self.size = 0

    def add(self, text: bytes, owner: int | None, copies: int) -> int | None:
        """Insert a string; the name of the subtree if that has been spilled."""
        node, at = self.root, 0
        while True:
            if node[3] == SPILL:
                return node[2]
            if at == len(text):
                node[2] = better(node[2], owner, self.keep) if node[3] else owner
                node[3] += copies
                return None
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, owner, copies]
                self.size += len(text) - at + NODE_BYTES
                return None
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = agreed(label, text, at)
            middle = [label[:same], {label[same]: child}, None, 0]
            child[0] = label[same:]
            node[1][text[at]] = middle
            self.size += NODE_BYTES
            node, at = middle, at + same

    def owners(self, node: list | None = None, path: bytes = b"") -> Iterator[Owner]:
        """The terminals below a node with this path, or of the whole trie."""
        stack = [(node or self.root, path)]
        while stack:
            node, path = stack.pop()
            if node[3] > 0:
                yield Owner(path, node[2], node[3])
            if node[3] != SPILL:
                stack += [(child, path + child[0]) for child in node[1].values()]

    def spill(self) -> Iterator[tuple[int, Owner]]:
        """Hand on subtrees, the heaviest of at most half the room first, until the trie has
        half of its room again. Nothing above a spilled subtree is spilled, so a string always
        gets the same name, and one string stays, so that every round ends with fewer."""
        while self.size > self.most // 2:
            nodes, parents = [self.root], [-1]
            for k, node in enumerate(nodes):  # grows while it runs: parents come first
                nodes += node[1].values()
                parents += [k] * len(node[1])
            sizes = [len(n[0]) + NODE_BYTES for n in nodes]
            whole = [n[3] != SPILL for n in nodes]
            for k in range(len(nodes) - 1, 0, -1):
                sizes[parents[k]] += sizes[k]
                whole[parents[k]] &= whole[k]
            able = [
                k for k in range(1, len(nodes)) if whole[k] and (sizes[k] <= self.most // 2 or not nodes[k][1])
            ]
            if not able or sum(n[3] > 0 for n in nodes) < 2:
                self.most = 2 * self.size  # one string, or what lies above spilled subtrees
                return
            best = max(able, key=sizes.__getitem__)
            node, path, k = nodes[best], b"", best
            while k > 0:
                path, k = nodes[k][0] + path, parents[k]
            name = xxh3_64_intdigest(path) >> 1
            for owner in self.owners(node, path):
                yield name, owner
            self.size -= sizes[best] - len(node[0]) - NODE_BYTES
            node[1], node[2], node[3] = {}, name, SPILL


SCHEMA = "text binary, owner long, copies long, part long, digest binary, spilled boolean"


def _rows(found: list[tuple[int | None, Owner]]) -> pa.RecordBatch:
    """Final terminals (part None: only the digest of the text goes on) and spilled ones."""
    final = [part is None for part, _ in found]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None if f else o.text for f, (_, o) in zip(final, found, strict=True)], pa.binary()),
            pa.array([o.owner for _, o in found], pa.int64()),
            pa.array([o.copies for _, o in found], pa.int64()),
            pa.array([part for part, _ in found], pa.int64()),
            pa.array(
                [hashlib.sha256(o.text).digest() if f else None for f, (_, o) in zip(final, found, strict=True)],
                pa.binary(),
            ),
            pa.array([not f for f in final], pa.bool_()),
        ],
        names=["text", "owner", "copies", "part", "digest", "spilled"],
    )


def _gathered(found: Iterable[tuple[int | None, Owner]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for part, owner in found:
        rows.append((part, owner))
        size += 100 if part is None else len(owner.text) + 100
        if size > OUT_BYTES:
            yield _rows(rows)
            rows, size = [], 0
    if rows:
        yield _rows(rows)


def owners_of(rows: DataFrame, keep: str, most: int) -> DataFrame:
    """One trie per partition of (text, owner, copies), whose equal texts share a partition:
    SCHEMA rows, the final ones (digest, owner, copies) and the spilled ones with the part
    that must take them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(keep, most)

        def inserted() -> Iterator[tuple[int | None, Owner]]:
            for batch in batches:
                columns = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
                for text, owner, copies in columns:
                    name = trie.add(text, owner, copies)
                    if name is not None:
                        yield name, Owner(text, owner, copies)
                    elif trie.size > trie.most:
                        yield from trie.spill()
            for owner in trie.owners():
                yield None, owner

        yield from _gathered(inserted())

    return rows.select("text", "owner", "copies").mapInArrow(run, SCHEMA)


def normalised(text: bytes | None) -> bytes:
    """What is compared: A-Z in lower case, null as empty."""
    return text.lower() if text else b""


def _texts(docs: DataFrame, keep: str) -> DataFrame:
    """(length, hash, text, owner, copies): equal texts of a batch are one row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, list] = {}
            for doc, raw in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                own = known.setdefault(normalised(raw), [doc, 0])
                own[0] = better(own[0], doc, keep)
                own[1] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(t) for t in known], pa.int64()),
                    pa.array([xxh3_64_intdigest(t) >> 1 for t in known], pa.int64()),
                    pa.array(list(known), pa.binary()),
                    pa.array([own[0] for own in known.values()], pa.int64()),
                    pa.array([own[1] for own in known.values()], pa.int64()),
                ],
                names=["length", "hash", "text", "owner", "copies"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "length long, hash long, text binary, owner long, copies long")


def _digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.sha256(normalised(raw)).digest() for raw in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary())], names=["doc_id", "digest"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary")


def text_owners(docs: DataFrame, keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Every different text of (doc_id, text) once: (digest, owner, copies).

    Equal texts of a batch become one row; the rows meet by length and content hash, and each
    partition inserts whole byte strings into its trie, so texts are the same only when every
    byte is. A trie over its room spills its heaviest subtrees as rows, which meet again by
    subtree in the next round, in as many partitions as their bytes need; there are rounds
    until nothing is spilled.
    """
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done: DataFrame | None = None
    found = saved(owners_of(_texts(docs, keep).repartition("length", "hash"), keep, trie_bytes))
    while True:
        final = found.where("not spilled").select("digest", "owner", "copies")
        done = final if done is None else done.union(final)
        rest = found.where("spilled")
        size = rest.agg(F.sum(F.octet_length("text") + NODE_BYTES)).first()[0]
        if not size:
            return done
        parts = max(least, 4 * size // trie_bytes)
        found = saved(owners_of(rest.repartition(parts, "part"), keep, trie_bytes))


def exact_duplicates(
    docs: DataFrame,
    keep: str = "smallest",
    id_column: str = "doc_id",
    text_column: str = "text",
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """Groups of equal texts, A-Z lower-cased and nothing else changed.

    Of a group the row with the smallest id stays, or the largest with keep="largest".
    Returns one row per row: doc_id, keep_id (id of the row that stays), group_size (rows of
    the group), kept, text_sha256 (lowercase hex, of the compared text in UTF-8). Null texts
    count as empty. A null id stays only where the whole group has none (keep_id null). Rows
    of one id and one text are all marked kept. Ids must be integers. Empty tables give no
    rows. A group may hold any part of all rows: texts that a thousandth of them or more share,
    of which there can be a thousand at most, find their rows by broadcast, the others
    by a join in which no key is larger.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    owners = saved(text_owners(narrow, keep, trie_bytes))
    rows = saved(_digests(narrow))
    total = owners.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") * SHARE >= F.lit(total)
    hot = F.broadcast(owners.where(is_hot))
    met = rows.join(hot, "digest").unionByName(
        rows.join(hot.select("digest"), "digest", "left_anti").join(owners.where(~is_hot), "digest")
    )
    return met.select(
        "doc_id",
        F.col("owner").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("owner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_exact_duplicates(
    docs: DataFrame, keep: str = "smallest", id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The documents without exact copies, every column as it was.

    The rows of the id that `exact_duplicates` keeps stay; if several rows have that id and
    that text, all of them do, as nothing tells which one to drop.
    """
    kept = exact_duplicates(docs, keep, id_column, text_column).where("kept").select(
        F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text")
    ).distinct()
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.coalesce(F.col(text_column).cast("string"), F.lit("")), upper, upper.lower())
    same = F.col(id_column).cast("long").eqNullSafe(F.col("_kept_id")) & (
        F.sha2(F.encode(text, "UTF-8"), 256) == F.col("_kept_text")
    )
    return docs.join(kept, same, "left_semi")


def op11_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents; the largest id stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""
