"""Merkle manifest of a dataset that stores every few levels and recomputes the rest."""

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteweave.llm.common import crc_part, saved, table

#: Levels from one stored level to the next: what a task regenerates at once has 2^STEP nodes
#: at its base.
STEP = 8

STEPS = "array<struct<left: boolean, hash: string>>"


def hashed(*parts: Column) -> Column:
    """H: lowercase hex of the SHA-256 of the joined texts in UTF-8."""
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def field(value: Column, is_text: bool) -> Column:
    """A value as its byte count, a colon and itself; `-` if null."""
    text = value if is_text else value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(docs: DataFrame, columns: list[str], changed: dict[str, Column] | None = None) -> Column:
    """The hash of a row over `columns`, with some of their values changed."""
    changed = changed or {}
    types = dict(docs.dtypes)
    return hashed(*[field(changed.get(c, F.col(f"`{c}`")), types[c] == "string") for c in columns])


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`pos`, the place of each row in its `tree` from 0, and `nodes`, the rows of the tree.

    Rows are range-partitioned and sorted by tree and order and written with their number;
    only the counts of (tree, partition) meet in one window, so no tree is gathered however
    many of the rows it holds.
    """
    keys = [F.col("tree").asc_nulls_first(), *order]
    placed = saved(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumns({"_id": F.monotonically_increasing_id(), "_part": F.spark_partition_id()})
    )
    sizes = placed.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    own = W.partitionBy("tree")
    starts = sizes.select(
        F.col("tree").alias("_tree"),
        F.col("_part").alias("_of"),
        (F.sum("_n").over(own.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_start"),
        F.sum("_n").over(own).alias("nodes"),
    )
    at = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_of"))
    return (
        placed.join(starts, at)
        .withColumn("pos", F.col("_id") + F.col("_start"))
        .drop("_id", "_part", "_tree", "_of", "_start", "_n")
    )


def levels_above(nodes: int) -> int:
    """Levels that STEP of them climb from a level with so many nodes, to its root at most."""
    return min(STEP, (nodes - 1).bit_length())


def climb(hashes: list[str], levels: int) -> list[list[str]]:
    """An aligned run of nodes and the levels above it: two consecutive nodes become their H,
    a last single one becomes the H of itself."""
    out = [hashes]
    for _ in range(levels):
        now = out[-1]
        pairs = ["".join(now[k : k + 2]) for k in range(0, len(now), 2)]
        out.append([hashlib.sha256(p.encode()).hexdigest() for p in pairs])
    return out


def stored_level(nodes: DataFrame) -> DataFrame:
    """From (tree, pos, nodes, hash) the stored level above it: every aligned block of
    2^STEP nodes becomes one, or the root of its tree."""

    def one(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n = block["nodes"][0].as_py()
        levels = levels_above(n)
        top = climb(block["hash"].to_pylist(), levels)[-1]
        return pa.table(
            {
                "tree": block["tree"].slice(0, 1),
                "pos": pa.array([key[1].as_py()], pa.int64()),
                "nodes": pa.array([-(-n >> levels)], pa.int64()),
                "hash": pa.array(top, pa.string()),
            }
        )

    kind = nodes.schema["tree"].dataType.simpleString()
    blocks = nodes.select("tree", "pos", "nodes", "hash", F.shiftright("pos", STEP).alias("block"))
    return blocks.groupBy("tree", "block").applyInArrow(one, f"tree {kind}, pos long, nodes long, hash string")


def stored_levels(leaves: DataFrame) -> list[DataFrame]:
    """The stored levels of (tree, pos, nodes, hash), from the leaves to the level that holds
    only roots. A tree whose root is reached early ends there."""
    levels = [leaves]
    while not levels[-1].where("nodes > 1").isEmpty():
        levels.append(saved(stored_level(levels[-1].where("nodes > 1"))))
    return levels


def steps_of(block: pa.Table, above: list[dict], level: int) -> pa.Array:
    """The proof of each node of a sorted block: its siblings at the `level` levels that are
    regenerated here, then the steps `above` the block's top."""
    hashes = block["hash"].to_pylist()
    n, own, rest = len(hashes), climb(hashes, level), len(above)
    at = np.arange(n)
    left = np.zeros((n, level + rest), bool)
    values = np.zeros((n, level + rest), "S64")
    there = np.zeros((n, level + rest), bool)
    for k in range(level):
        nodes = np.array(own[k], "S64")
        other = (at >> k) ^ 1
        there[:, k] = other < len(nodes)
        left[:, k] = other & 1 == 0
        values[:, k] = nodes[np.minimum(other, len(nodes) - 1)]
    for k, step in enumerate(above):
        left[:, level + k] = step["left"]
        there[:, level + k] = step["hash"] is not None
        values[:, level + k] = (step["hash"] or "").encode()
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(64), values.size, [None, pa.py_buffer(values.tobytes())])
    text = pa.array(flat.cast(pa.binary()).to_numpy(zero_copy_only=False), pa.binary(), mask=~there.reshape(-1))
    steps = pa.StructArray.from_arrays([pa.array(left.reshape(-1)), text.cast(pa.string())], ["left", "hash"])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (level + rest), pa.int32()), steps)


def proofs_of_level(nodes: DataFrame, uppers: DataFrame) -> DataFrame:
    """The nodes of one stored level with `steps`, their proof up to the manifest's root, and
    `subroot` and `root`.

    Each aligned block meets the proof of its top node; the levels between are regenerated
    from the block, give their siblings and are dropped. Uppers are (tree, pos, steps,
    subroot, root), one a block.
    """
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields] + [f"steps {STEPS}, subroot string, root string"]
    )

    def one(key: tuple, block: pa.Table, upper: pa.Table) -> pa.Table:
        block = block.sort_by("pos").drop_columns("block")
        top = upper.to_pylist()[0]
        level = levels_above(block["nodes"][0].as_py())
        steps = steps_of(block, top["steps"], level)
        n = len(block)
        return (
            block.append_column("steps", steps)
            .append_column("subroot", pa.array([top["subroot"]] * n, pa.string()))
            .append_column("root", pa.array([top["root"]] * n, pa.string()))
        )

    blocks = nodes.withColumn("block", F.shiftright("pos", STEP)).groupBy("tree", "block")
    tops = uppers.select("tree", F.col("pos").alias("block"), "steps", "subroot", "root").groupBy("tree", "block")
    return blocks.cogroup(tops).applyInArrow(one, schema)


def proofs(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with their proofs. `tops` has the proof of each tree's root: (tree, pos 0,
    steps, subroot, root). Stored levels are walked from the top; the nodes of one are the
    tops of the blocks of the one below it, or the roots of trees that end there."""
    top = tops.drop("pos").withColumnRenamed("tree", "_top")
    known = None
    for k in range(len(levels) - 1, -1, -1):
        ended = levels[k].where("nodes = 1")
        now = ended.join(top, F.col("tree").eqNullSafe(F.col("_top"))).drop("_top")
        if known is not None:
            now = proofs_of_level(levels[k].where("nodes > 1"), known).unionByName(now)
        known = saved(now.select("tree", "pos", "steps", "subroot", "root")) if k else now
    return known


def manifest(leaves: DataFrame, order: list[Column]) -> tuple[list[DataFrame], DataFrame]:
    """The manifest of rows (tree, hash, ...): the stored levels of every tree, and `tops`, the
    proof of each tree's root in the tree of all roots.

    Within a tree leaves ascend by `order`; the trees ascend by name, null first. What is
    stored is the leaves and each STEP-th level above them.
    """
    levels = stored_levels(saved(numbered(leaves, order)))
    ends = [level.where("nodes = 1").select("tree", "hash") for level in levels]
    roots = ends[0]
    for end in ends[1:]:
        roots = roots.unionByName(end)
    named = roots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "hash")
    over = saved(numbered(named, [F.col("name").asc_nulls_first()]))
    above = stored_levels(over)
    root = above[-1].where("nodes = 1").select("tree", F.col("hash").alias("root"))
    start = root.select(
        "tree",
        F.lit(0).cast("long").alias("pos"),
        F.array().cast(STEPS).alias("steps"),
        F.lit("").alias("subroot"),
        "root",
    )
    tops = proofs(above, start).select(
        F.col("name").alias("tree"),
        F.lit(0).cast("long").alias("pos"),
        "steps",
        F.col("hash").alias("subroot"),
        "root",
    )
    return levels, saved(tops)


def write_manifest(levels: list[DataFrame], tops: DataFrame, path: str):
    """Store a manifest under a new path, a folder per stored level."""
    for k, level in enumerate(levels):
        level.write.parquet(f"{path}/level_{k}")
    tops.withColumn("levels", F.lit(len(levels))).write.parquet(f"{path}/tops")


def read_manifest(spark: SparkSession, path: str) -> tuple[list[DataFrame], DataFrame]:
    """A stored manifest as `proofs` takes it; without rows it has its leaves' level only."""
    tops = spark.read.parquet(f"{path}/tops")
    first = tops.first()
    levels = [spark.read.parquet(f"{path}/level_{k}") for k in range(first["levels"] if first else 1)]
    return levels, tops.drop("levels")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""

    def up(now: Column, step: Column) -> Column:
        other = step["hash"]
        return hashed(
            F.when(step["left"] & other.isNotNull(), other).otherwise(F.lit("")),
            now,
            F.when(~step["left"] & other.isNotNull(), other).otherwise(F.lit("")),
        )

    return F.aggregate(steps, leaf, up)


def document_proofs(
    docs: DataFrame,
    columns: list[str],
    id_column: str = "doc_id",
    tree_column: str = "lang",
    carried: dict[str, Column] | None = None,
) -> DataFrame:
    """A leaf and its inclusion proof for every row.

    A leaf is the hash of the named columns. The leaves of one `tree_column` value ascend by
    id, null first, ties by their hash, and form a binary tree; the roots of these trees form
    another one. Returns one row per row: doc_id, leaf, steps (for each level upwards the
    sibling and whether it stands on the left; hash null where a node has none), subroot, root,
    and `carried`, further columns by name. Repeated rows are leaves of their own; empty
    tables give no rows.
    """
    carried = carried or {}
    leaves = docs.select(
        F.col(f"`{tree_column}`").alias("tree"),
        F.col(f"`{id_column}`").alias("doc_id"),
        leaf_of(docs, columns).alias("hash"),
        *[c.alias(name) for name, c in carried.items()],
    )
    levels, tops = manifest(leaves, [F.col("doc_id").asc_nulls_first(), F.col("hash")])
    found = proofs(levels, tops)
    return found.select("doc_id", F.col("hash").alias("leaf"), "steps", "subroot", "root", *carried)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, some of them tampered with."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc_part("doc_id", 7) == 0, leaf_of(docs, COLUMNS, {"n_chars": F.col("n_chars") + 1}))
    found = document_proofs(docs, COLUMNS, carried={"tampered": tampered})
    siblings = F.transform(F.col("steps"), lambda s: s["hash"])
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        hashed(F.concat_ws("", siblings)).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in COLUMNS) + ")"
_TAMPERED = _LEAF.replace("n_chars::", "(n_chars + 1)::")
#: Unsigned CRC-32 of the decimal doc_id, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
        lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295)"""

OP13_SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_TAMPERED} END AS tampered,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
  FROM documents),
tree AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(1, len(nodes) + 1, 2),
                                         lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))
  FROM tree WHERE len(nodes) > 1),
subs AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos
  FROM tree WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subs
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2),
                                   lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))
  FROM top WHERE len(nodes) > 1),
steps AS (
  SELECT doc_id, level, pos >> level AS place, nodes FROM leaves l JOIN tree t ON l.lang IS NOT DISTINCT FROM t.lang
  WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, level + 1000, s.pos >> level, nodes
  FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN top WHERE len(nodes) > 1),
sibling AS (
  SELECT doc_id, level, nodes[xor(place, 1) + 1] AS hash, CASE WHEN place & 1 = 1 THEN 'L' ELSE 'R' END AS side FROM steps),
proof AS (
  SELECT doc_id, list(side || coalesce(hash, '') ORDER BY level) AS path,
         coalesce(string_agg(hash, '' ORDER BY level), '') AS joined
  FROM sibling GROUP BY doc_id),
result AS (
  SELECT l.doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root,
         sha256(coalesce(joined, '')) AS proof_sha256,
         list_reduce(list_concat([coalesce(tampered, leaf)], coalesce(path, [])),
                     lambda acc, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || acc ELSE acc || s[2:] END)) AS folded_root
  FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN proof p ON p.doc_id = l.doc_id)
SELECT *, folded_root = root AS verified FROM result
"""
