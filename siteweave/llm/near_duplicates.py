"""Near duplicates by MinHash with tensored banding, confirmed on whole shingle sets."""

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm.common import (
    TILE_KEYS,
    connected,
    likely,
    mixed,
    parted,
    pieces,
    roots_of,
    saved,
    shingles_of,
    table,
    texts_of,
    tiled,
    words_of,
)

#: Two collections of HALF sketches, each of ROWS minhashes. A table's key pairs a sketch of
#: the first with one of the second: HALF**2 tables of 2 * ROWS rows from 2 * HALF * ROWS
#: minhashes. Sets of similarity s meet in some table with probability
#: (1 - (1 - s**ROWS)**HALF)**2: at 0.75 all but 4 in a million, at 0.27 one in seven.
ROWS = 3
HALF = 24
HASHES = 2 * HALF * ROWS
#: Sets of similarity 0.75 agree in 108 of the 144 minhashes on average, and in fewer than
#: this part of the expected number with a probability of about 1e-8.
LEAST_SHARE = 0.73
#: Sets on each side of a tile, and shingles.
TILE_SETS = 256
TILE_SHINGLES = 2_000_000

_RNG = np.random.Generator(np.random.PCG64(7))
_MUL = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_SALT = _RNG.integers(0, 1 << 63, 2 * HALF, dtype=np.uint64)

SKETCH = "id long, mark long, n long, f1 long, f2 long, sketches array<long>"
FINGERPRINT = ["n", "f1", "f2"]
#: A set that this part of all rows or more share goes to them by broadcast; there are SHARE
#: such sets at most.
SHARE = 1000


def minhashes(shingles: np.ndarray, block: int = 4096) -> np.ndarray:
    """The least value of each hash function over the set, in blocks."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), block):
        np.minimum(least, (_MUL[:, None] * low[None, k : k + block] + _ADD[:, None]).min(axis=1), out=least)
    return least


def fingerprint(shingles: np.ndarray) -> tuple:
    """The size of a set and 128 bits of what is in it."""
    second = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D))
    return len(shingles), shingles.sum(dtype=np.uint64), second.sum(dtype=np.uint64)


def sketch_rows(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces(batch, 1)):
            n, f1, f2, subs = [], [], [], []
            for text in texts_of(piece.column(1)):
                shingles = shingles_of(words_of(text), width)
                for out, value in zip((n, f1, f2), fingerprint(shingles), strict=True):
                    out.append(value)
                if len(shingles):
                    least = minhashes(shingles)
                    rows = least.reshape(2 * HALF, ROWS).astype(np.uint64)
                    key = _SALT.copy()
                    for k in range(ROWS):
                        key = mixed(key + rows[:, k])
                    subs.append(key.view(np.int64))
                else:
                    subs.append(np.empty(0, np.int64))
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            lists = lambda x: pa.array(x, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(2), longs(n), longs(f1), longs(f2), lists(subs)],
                names=["id", "mark", "n", "f1", "f2", "sketches"],
            )

    return run


def set_rows(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces(batch, 1)):
            sets = [shingles_of(words_of(t), width) for t in texts_of(piece.column(1))]
            prints = np.array([fingerprint(x) for x in sets], np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    *[pa.array(prints[:, k]) for k in range(3)],
                    pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                ],
                names=["id", "n", "f1", "f2", "shingles"],
            )

    return run


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have at least `percent` % of their union in common."""
    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(first, "a")
        .join(second, "b")
        .select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
        .where(F.lit(100) * F.col("both") >= percent * (F.col("sum") - F.col("both")))
        .select("a", "b")
    )


def shared_values(rows: DataFrame, value: str, holder: str) -> DataFrame:
    """The rows whose value has another holder."""
    several = (
        rows.groupBy(value)
        .agg(F.min(holder).alias("lo"), F.max(holder).alias("hi"))
        .where("lo < hi")
        .select(value)
    )
    return rows.join(several, value, "left_semi")


def table_keys(reps: DataFrame) -> DataFrame:
    """(key, id) for all tables. A sketch that one set alone holds can meet nothing, nor can
    a key made with it, so keys are formed from the shared sketches only."""
    slots = reps.select("id", F.posexplode("sketches").alias("slot", "value"))
    alive = (
        shared_values(slots, "value", "id")
        .groupBy("id")
        # at most 2 * HALF values
        .agg(
            F.collect_set(F.when(F.col("slot") < HALF, F.col("value"))).alias("xs"),
            F.collect_set(F.when(F.col("slot") >= HALF, F.col("value"))).alias("ys"),
        )
    )
    pairs = F.flatten(
        F.transform("xs", lambda x: F.transform("ys", lambda y: F.xxhash64(x, y)))
    )
    return alive.select("id", F.explode(pairs).alias("key"))


def near_duplicates(
    docs: DataFrame,
    percent: int = 75,
    width: int = 5,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of `percent` % or more.

    1. One pass makes each text's shingle count, set fingerprint and sketches. Texts of
       equal sets form a class, whatever their ids.
    2. Classes meet in tables whose keys pair two sketches.
    3. Each class is compared with one class: the first of the table that they meet in
       most often. Links join into components. This costs one comparison a class and draws
       large groups together; tables within one component are done with.
    4. Classes that still share a table with another component form clusters. In a cluster
       every two sets of different components and fitting sizes are compared, in tiles that
       hold each set a few times and return links between components, not pairs.
    5. Comparisons use the whole shingle sets, made again for classes that share a table.

    Returns one row per row: doc_id, n_shingles, component_id (smallest doc_id reachable,
    itself included), kept. Null, empty and blank texts have no shingles and no links. A row
    without id has no component_id, links with nothing and is kept. Texts of one id are each
    on their own. The order of rows and other columns don't matter; no rows give none.
    """
    return _grouped(docs, percent, width, id_column, text_column).select("doc_id", "n_shingles", "component_id", "kept")


def _narrow(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column)
    return docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def _grouped(docs: DataFrame, percent: int, width: int, id_column: str, text_column: str) -> DataFrame:
    """`near_duplicates` with `mark`, a hash of the text, and `component`, null where a row
    links with nothing by rule."""
    narrow = _narrow(docs, id_column, text_column)
    sketches = saved(narrow.mapInArrow(sketch_rows(width), SKETCH))
    filled = sketches.where("id is not null and n > 0")
    counts = filled.groupBy(*FINGERPRINT).agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    classes, seed = saved(counts), 0
    # a class is named by a hash of its fingerprint, with a seed under which no two share one
    while True:
        node = F.xxhash64(F.lit(seed), *FINGERPRINT)
        if classes.select(node.alias("node")).groupBy("node").count().where("count > 1").isEmpty():
            break
        seed += 1
    classes = classes.withColumn("node", node)
    firsts = classes.select(F.col("first").alias("id"), *FINGERPRINT)
    reps = filled.join(firsts, ["id", *FINGERPRINT], "left_semi").select(node.alias("id"), "sketches")
    buckets = saved(shared_values(table_keys(reps), "key", "id"))
    wanted = classes.join(buckets.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    ids = saved(wanted.select(F.col("first").alias("id")).distinct())
    # a set too many meets nothing, and shuffling the texts would cost far more
    again = likely(narrow, ids, ["id"]).where("likely").select("id", "text").mapInArrow(
        set_rows(width), "id long, n long, f1 long, f2 long, shingles array<long>"
    )
    sets = saved(again.where("n > 0").select(node.alias("id"), "shingles"))
    near = saved(linked_pairs(star_pairs(buckets), sets, percent))
    open_ = saved(unresolved(buckets, near))
    groups = connected(saved(near.union(cluster_links(open_, sets, percent))))
    joined = saved(
        classes.join(groups, "node", "left").select(
            *FINGERPRINT, "first", "rows", F.coalesce("component", "node").alias("component")
        )
    )
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    found = saved(joined.join(smallest, "component"))
    total = found.agg(F.sum("rows")).first()[0] or 0
    is_hot = F.col("rows") * SHARE >= F.lit(total)
    rows = filled.select("id", "mark", *FINGERPRINT)
    hot = F.broadcast(found.where(is_hot))
    placed = rows.join(hot, FINGERPRINT).unionByName(
        rows.join(hot.select(*FINGERPRINT), FINGERPRINT, "left_anti").join(found.where(~is_hot), FINGERPRINT)
    )
    alone = sketches.where("id is null or n = 0").select(
        "id", "mark", "n", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id")
    )
    return placed.select(*alone.columns).union(alone).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        "mark",
        "component",
    )


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that stay: one of each group, the one of the smallest id. All columns
    stay as they are. Rows without id stay. Of several texts of that id in the group one
    stays, by a hash of the text, and so does one of rows that repeat id and text."""
    found = saved(_grouped(docs, 75, 5, id_column, text_column))
    best = found.where("kept and component is not null").groupBy("component").agg(F.min("mark").alias("best"))
    own = ["doc_id", "mark"]
    stays = F.col("kept") & (F.col("mark") == F.col("best"))
    judged = found.where("component is not null").select(*own, "kept", "component").distinct().join(best, "component")
    gone = saved(judged.where(~stays).select(*own).distinct())
    again = saved(found.where("doc_id is not null").join(gone, own, "left_anti").groupBy(*own).count().where("count > 1"))
    marked = docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in zip(own, _own(id_column, text_column), strict=True)])
    _, kept = parted(marked, gone, own)
    if again.isEmpty():
        return kept.select("row.*")
    repeated, once = parted(kept, again, own)
    return once.select("row.*").union(repeated.dropDuplicates(own).select("row.*"))


def _own(id_column: str, text_column: str) -> tuple[Column, Column]:
    return F.col(id_column).cast("long"), F.xxhash64(F.col(text_column))


def star_pairs(buckets: DataFrame) -> DataFrame:
    """For each class the one it meets most often among its tables' smallest: at most one
    pair (a, b), a < b, a class."""
    low = buckets.groupBy("key").agg(F.min("id").alias("low"))
    times = buckets.join(low, "key").where("id > low").groupBy("id", "low").count()
    best = times.groupBy("id").agg(F.min_by("low", F.struct(-F.col("count"), "low")).alias("low"))
    return best.select(F.col("low").alias("a"), F.col("id").alias("b"))


def unresolved(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """(key, id, comp) of the tables' buckets that hold more than one component."""
    groups = connected(links).withColumnRenamed("node", "id")
    labelled = saved(
        buckets.join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    )
    return shared_values(labelled, "key", "comp")


def cluster_links(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket, enough to join whatever links.

    Buckets that share a class form a cluster. Sizes that can link lie in equal or
    neighbouring classes of the logarithm, which are the tiles' cells.
    """
    low = open_.groupBy("key").agg(F.min("id").alias("low"))
    edges = open_.join(low, "key").where("id > low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    clusters = connected(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    members = open_.select("id", "comp").distinct().join(clusters, "id")
    step = math.log(100 / percent) * (1 + 1e-9)
    placed = saved(
        members.join(sets.dropDuplicates(["id"]), "id")
        .withColumn("n", F.size("shingles"))
        .withColumn("cell", F.floor(F.log("n") / F.lit(step)).cast("int"))
    )
    parts = F.ceil(F.greatest(F.count("*") / TILE_SETS, F.sum("n") / TILE_SHINGLES))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[pdf["side"] == 0]
        same = pdf["step"].iat[0] == 0 and pdf["i"].iat[0] == pdf["j"].iat[0]
        b = a if same else pdf[pdf["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        i, j = tile_links(list(a["shingles"]), list(b["shingles"]), a["comp"].to_numpy(), b["comp"].to_numpy(), percent, same)
        node = a["id"].to_numpy() if same else np.concatenate([a["id"], b["id"]])
        root = node[roots_of(len(node), i, j if same else j + len(a))]
        return pd.DataFrame({"a": root, "b": node})[root != node]

    dealt = tiled(placed, ["cluster"], parts, "id")
    return dealt.groupBy("cluster", *TILE_KEYS).applyInPandas(compare, "a long, b long")


def tile_links(xs: list, ys: list, cx: np.ndarray, cy: np.ndarray, percent: int, same: bool):
    """Index pairs (i, j) of linked sets of different components. Sizes and the agreement of
    minhashes rule most pairs out; the others are compared in full."""
    nx, ny = (np.array(list(map(len, s))) for s in (xs, ys))
    fits = (cx[:, None] != cy[None, :]) & (100 * np.minimum.outer(nx, ny) >= percent * np.maximum.outer(nx, ny))
    if same:
        fits = np.triu(fits, 1)
    agree = np.zeros(fits.shape, np.uint8)
    hx = np.stack([minhashes(np.asarray(s).view(np.uint64)) for s in xs], axis=1)
    hy = hx if same else np.stack([minhashes(np.asarray(s).view(np.uint64)) for s in ys], axis=1)
    for u, v in zip(hx, hy, strict=True):
        agree += u[:, None] == v[None, :]
    i, j = np.nonzero(fits & (agree >= LEAST_SHARE * HASHES * percent / 100))
    wx = {k: set(xs[k].tolist()) for k in set(i.tolist())}
    wy = {k: set(ys[k].tolist()) for k in set(j.tolist())}
    both = np.fromiter((len(wx[p] & wy[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)), np.int64, len(i))
    keep = 100 * both >= percent * (nx[i] + ny[j] - both)
    return i[keep], j[keep]


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Every set of shingles is compared with every other that shares one, and links are followed.
OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
classes AS (SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM classes),
common AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM items a JOIN items b ON a.g = b.g AND a.rep < b.rep
      AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY ALL),
pairs AS (SELECT a, b FROM common WHERE 100 * k >= 75 * (na + nb - k)),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT rep, rep FROM classes UNION
  SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(component, sets.doc_id) AS component_id,
  sets.doc_id = coalesce(component, sets.doc_id) AS kept
FROM sets LEFT JOIN classes USING (s) LEFT JOIN comp USING (rep)
"""
