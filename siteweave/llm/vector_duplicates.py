"""Near-duplicate vectors by PCA-ordered tiled comparison."""

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm.common import TILE_KEYS, connected, roots_of, saved, table, tiled

#: Vectors on each side of a tile.
TILE = 2048
#: Leading dimensions after which the bound is looked at.
STOPS = (8, 16, 32)
#: A bound may be this much too low by rounding; the decision itself is made afterwards.
SLACK = 1e-9
#: Pairs whose components are gathered at once.
PAIRS = 200_000


def usable(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their doubles; null where nothing can be compared."""
    for batch in batches:
        raw: list[bytes | None] = []
        for v in batch.column(2).to_pylist():
            x = None if not v or None in v else np.array(v, np.float64)
            fit = x is not None and np.isfinite(x).all() and x.any()
            raw.append((x + 0.0).tobytes() if fit else None)
        sizes = pa.array([len(r) // 8 if r else None for r in raw], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(raw, pa.binary()), sizes], names=["vec_id", "label", "raw", "dim"]
        )


def unit(raw: Iterable[bytes]) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square overflows."""
    x = np.stack([np.frombuffer(r, np.float64) for r in raw])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """The principal axes by number of dimensions, as columns by falling variance.

    The second moments are summed in the tasks and then by Spark; the driver gets a matrix
    of dim**2 numbers. Any orthogonal axes give right results; these give short suffixes.
    """

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, own in batch.to_pandas().groupby("dim"):
                x = unit(own["raw"])
                total[dim] = total.get(dim, 0.0) + x.T @ x
        for dim, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dim * dim, dim, np.int32)), pa.array(np.arange(dim * dim, dtype=np.int32)), pa.array(m.ravel())],
                names=["dim", "at", "value"],
            )

    sums = (
        classes.select("dim", "raw")
        .mapInArrow(moments, "dim int, at int, value double")
        .groupBy("dim", "at")
        .agg(F.sum("value").alias("value"))
        .toPandas()
    )
    found = {}
    for dim, own in sums.groupby("dim"):
        m = own.sort_values("at")["value"].to_numpy().reshape(dim, dim)
        found[int(dim)] = np.linalg.eigh(m)[1][:, ::-1].copy()
    return found


def linked(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, least: float, same: bool):
    """Index pairs (i, j) with cosine >= least; with `same`, i < j.

    x and y hold the rotated unit vectors, ux and uy the given ones. The product of the
    leading dimensions plus the product of the suffixes' norms bounds the cosine; pairs are
    given up as soon as the bound is too low. The cosine that decides is that of the given
    vectors.
    """
    dim = x.shape[1]
    stops = [s for s in STOPS if s < dim] + [dim]
    norms = lambda v, s: np.sqrt((v[:, s:] ** 2).sum(axis=1))
    # in whole blocks while many pairs are left
    product, at = x[:, : stops[0]] @ y[:, : stops[0]].T, 0
    while True:
        alive = product + np.outer(norms(x, stops[at]), norms(y, stops[at])) >= least - SLACK
        if same:
            alive = np.triu(alive, 1)
        if stops[at] == dim or alive.mean() < 0.1:
            break
        product += x[:, stops[at] : stops[at + 1]] @ y[:, stops[at] : stops[at + 1]].T
        at += 1
    i, j = np.nonzero(alive)
    part = product[i, j]
    del product, alive
    # and pair by pair for the few that remain
    while stops[at] < dim and len(i):
        low, high = stops[at], stops[at + 1]
        for k in range(0, len(i), PAIRS):
            s = slice(k, k + PAIRS)
            part[s] += np.einsum("ij,ij->i", x[i[s], low:high], y[j[s], low:high])
        keep = part + norms(x, high)[i] * norms(y, high)[j] >= least - SLACK
        i, j, part, at = i[keep], j[keep], part[keep], at + 1
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), PAIRS):
        s = slice(k, k + PAIRS)
        keep[s] = np.einsum("ij,ij->i", ux[i[s]], uy[j[s]]) >= least
    return i[keep], j[keep]


def near_vectors(
    vectors: DataFrame,
    least: float = 0.93,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """Vectors of one label linked by a cosine of `least` or more, in double precision.

    Equal vectors form a class that is compared once. Vectors are rotated to the principal
    axes. Unit vectors that are so near differ by at most w = sqrt(2 - 2 * least) on the
    first axis, so a cell of width w is compared with itself and the next one, in tiles of
    at most about TILE vectors a side. A tile adds up dimensions in the order of their
    variance, bounds what is left and stops where the cosine can't be reached. A tile
    returns link counts and one link for each vector, not its pairs.

    Returns one row per row: vec_id, n_links, component_id, kept. Null, empty and zero
    vectors, those with a null or non-finite component, and rows without label or id link
    with nothing, and are kept. Vectors of different lengths never link. Repeated rows are
    other vectors that link. No rows give none.
    """
    given = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(label_column).cast("string").alias("label"),
        F.col(vector_column).cast("array<double>").alias("v"),
    )
    rows = saved(given.mapInArrow(usable, "vec_id long, label string, raw binary, dim int"))
    fit = rows.where("vec_id is not null and label is not null and raw is not null")
    classes = saved(
        fit.groupBy("label", "dim", "raw")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
        # fixed once written
        .withColumn("node", F.monotonically_increasing_id())
    )
    rotation = axes(classes)
    width = float(np.sqrt(max(1e-6, 2 - 2 * least)))

    def celled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            pdf["cell"] = 0
            for dim, own in pdf.groupby("dim"):
                first = unit(own["raw"]) @ rotation[dim][:, 0]
                pdf.loc[own.index, "cell"] = np.floor(first / width).astype(np.int32)
            pdf["cell"] = pdf["cell"].astype("int32")
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    kinds = "label string, dim int, raw binary, copies long, node long"
    placed = saved(
        classes.select("label", "dim", "raw", "copies", "node").mapInArrow(celled, f"{kinds}, cell int")
    )
    dealt = tiled(placed, ["label", "dim"], F.ceil(F.count("*") / TILE), "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[pdf["side"] == 0]
        same = pdf["step"].iat[0] == 0 and pdf["i"].iat[0] == pdf["j"].iat[0]
        b = a if same else pdf[pdf["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "links": [], "root": []}, dtype=np.int64)
        turn = rotation[int(pdf["dim"].iat[0])]
        ua = unit(a["raw"])
        ub = ua if same else unit(b["raw"])
        i, j = linked(ua @ turn, ub @ turn, ua, ub, least, same)
        shift = 0 if same else len(a)
        node = a["node"].to_numpy() if same else np.concatenate([a["node"], b["node"]])
        copies = a["copies"].to_numpy() if same else np.concatenate([a["copies"], b["copies"]])
        links = np.bincount(i, copies[j + shift], len(node)) + np.bincount(j + shift, copies[i], len(node))
        root = node[roots_of(len(node), i, j + shift)]
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "root": root[some]})

    met = saved(dealt.groupBy("label", "dim", *TILE_KEYS).applyInPandas(compare, "node long, links long, root long"))
    groups = connected(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("node", "label", "dim", "raw", "copies", "low").join(groups, "node", "left")
    smallest = named.groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("low").alias("component_id"))
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    known = saved(
        named.join(smallest, F.coalesce("component", "node") == F.col("c"))
        .join(counts, "node", "left")
        .select("label", "dim", "raw", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    # rows with anything null find no class here
    fit_id = F.col("vec_id").isNotNull()
    component = F.when(fit_id, F.coalesce("component_id", "vec_id"))
    return rows.join(
        known.withColumn("fits", F.lit(True)),
        (rows["label"] == known["label"]) & (rows["dim"] == known["dim"]) & (rows["raw"] == known["raw"]) & fit_id,
        "left",
    ).select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op5_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Every pair of one label, and links followed.
OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id,
  e.vec_id = coalesce(c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN comp ON comp.a = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id
"""
