"""Ranked lexical search by MaxScore, with bounds of term pairs beside those of terms."""

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteweave.llm.common import saved, table, texts_of

#: Documents of a segment, the unit that is indexed and searched on its own.
SEGMENT_DOCS = 8192
#: Bytes of items' terms that are searched for at once; more items take several blocks.
BLOCK_BYTES = 4 << 20
#: Size of a score's scale.
SCALE = 1_000_000_000

#: ASCII letters and digits and everything beyond ASCII make terms; A-Z in lower case.
_TERMS = bytes(
    b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a whole text, in order."""
    return text.translate(_TERMS).split() if text else []


class Block(NamedTuple):
    """Items that are searched for together. A term is its place in `terms`; the terms of an
    item are ordered by falling weight, and `links` has the pair of each two neighbours."""

    ids: list[int | None]
    orders: list[np.ndarray]
    links: list[np.ndarray]
    weights: np.ndarray
    pairs: np.ndarray


class Segment:
    """Posting lists of some documents: of single terms, and of the pairs' intersections,
    each with the largest impact in it."""

    def __init__(self, terms: int, pairs: int):
        self.docs, self.nulls = np.empty(0, np.int64), np.empty(0, bool)
        self.postings: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.joint: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.most = np.zeros(terms, np.int64)
        self.joint_most = np.zeros(pairs, np.int64)


# --- the index -----------------------------------------------------------------------


def forward_rows(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, ids, tfs) of every row: its number of terms, and those of `terms` in it with
    how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            sizes, ids, tfs, ends = [], [], [], [0]
            for raw in texts_of(batch.column(1)):
                found = terms_of(raw)
                counts = Counter(map(known, found))
                counts.pop(None, None)
                sizes.append(len(found))
                ids += counts.keys()
                tfs += counts.values()
                ends.append(len(ids))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64())),
                ],
                names=["doc_id", "n", "ids", "tfs"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<long>")


def impacts_of(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What a term adds to the score of a document of n terms, in whole numbers."""
    m = 10 + 90 * n * docs // length
    return weight * (SCALE * tf // (1000 * tf + 8 * m))


INDEX = "segment long, term int, pair int, most long, docs array<int>, impacts array<long>, doc_ids array<long>"


def index_rows(forward: DataFrame, block: Block, docs: int, length: int) -> DataFrame:
    """The index, segment by segment: INDEX rows.

    A row with doc_ids lists the documents of a segment; one with `term` has the places of
    its documents and their impacts; one with `pair` has the intersection of the two terms'
    lists and their joint impacts. `most` is the largest impact of the row.
    """
    shared = forward.sparkSession.sparkContext.broadcast(block)

    def segment_rows(name: int, ids: list, n: list, terms: list, tfs: list) -> pa.RecordBatch:
        own = shared.value
        place = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
        term = np.concatenate(terms)
        tf = np.concatenate(tfs)
        impact = impacts_of(tf, np.asarray(n, np.int64)[place], own.weights[term], docs, length)
        order = np.lexsort((place, term))
        place, term, impact = place[order].astype(np.int32), term[order], impact[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        lists = dict(
            zip(term[first].tolist(), zip(np.split(place, first[1:]), np.split(impact, first[1:]), strict=True), strict=True)
        )
        rows = [(k, None, at, value) for k, (at, value) in lists.items()]
        at_of_a = np.zeros(len(ids), np.int64)
        for k, (a, b) in enumerate(own.pairs.tolist()):
            if a in lists and b in lists:
                (at, value), (at_b, value_b) = lists[a], lists[b]
                at_of_a[at] = value + 1
                both = at_of_a[at_b] > 0
                if both.any():
                    rows.append((None, k, at_b[both], value_b[both] + at_of_a[at_b[both]] - 1))
                at_of_a[at] = 0
        ends = np.concatenate([[0, 0], np.cumsum([len(at) for _, _, at, _ in rows])]).astype(np.int32)
        places = pa.array(np.concatenate([at for _, _, at, _ in rows]), pa.int32())
        values = pa.array(np.concatenate([v for _, _, _, v in rows]), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name] * (len(rows) + 1), pa.int64()),
                pa.array([None] + [t for t, _, _, _ in rows], pa.int32()),
                pa.array([None] + [p for _, p, _, _ in rows], pa.int32()),
                pa.array([None] + [int(v.max()) for _, _, _, v in rows], pa.int64()),
                pa.ListArray.from_arrays(ends, places),
                pa.ListArray.from_arrays(ends, values),
                pa.array([ids] + [None] * len(rows), pa.list_(pa.int64())),
            ],
            names=["segment", "term", "pair", "most", "docs", "impacts", "doc_ids"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        ids, n, terms, tfs = [], [], [], []
        for batch in batches:
            lists = [batch.column(k) for k in (2, 3)]
            ends = lists[0].offsets.to_numpy()
            flat = [x.values.to_numpy() for x in lists]
            keys, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                ids.append(keys[k])
                n.append(sizes[k])
                terms.append(flat[0][low:high])
                tfs.append(flat[1][low:high])
                if len(ids) == SEGMENT_DOCS:
                    yield segment_rows(name, ids, n, terms, tfs)
                    name += 1
                    ids, n, terms, tfs = [], [], [], []
        if ids:
            yield segment_rows(name, ids, n, terms, tfs)

    return forward.where(F.size("ids") > 0).mapInArrow(run, INDEX)


# --- the search ----------------------------------------------------------------------


class Unit(NamedTuple):
    """A term, or two whose joint bound is lower than the sum of theirs (`pair` >= 0)."""

    bound: int
    terms: tuple[int, ...]
    pair: int
    single: int  # the most that one of the terms adds alone


def units_of(order: np.ndarray, links: np.ndarray, segment: Segment, use_pairs: bool = True) -> list[Unit]:
    """An item's terms in this segment as units of the lowest bounds.

    A document has both terms of a pair, and at most their joint maximum of it, or one of
    them. Neighbours are paired so that the bounds' sum becomes as low as it can be."""
    most = segment.most[order].tolist()
    joint = segment.joint_most[links].tolist()
    best = [0] * (len(most) + 1)
    for k in range(2, len(most) + 1):
        a, b = most[k - 2], most[k - 1]
        saved_ = a + b - max(joint[k - 2], a, b) if use_pairs else 0
        best[k] = max(best[k - 1], best[k - 2] + saved_)
    out, k = [], len(most)
    while k > 0:
        if best[k] > best[k - 1]:
            a, b, both = most[k - 2], most[k - 1], joint[k - 2]
            out.append(Unit(max(a, b, both), (int(order[k - 2]), int(order[k - 1])), int(links[k - 2]), max(a, b)))
            k -= 2
        else:
            if most[k - 1]:
                out.append(Unit(most[k - 1], (int(order[k - 1]),), -1, most[k - 1]))
            k -= 1
    return out


def looked_up(lists: tuple[np.ndarray, np.ndarray] | None, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `docs` the list has, and the impacts of these."""
    if lists is None or not len(docs):
        return np.zeros(len(docs), bool), np.empty(0, np.int64)
    at = np.searchsorted(lists[0], docs)
    at[at == len(lists[0])] = 0
    hit = lists[0][at] == docs
    return hit, lists[1][at[hit]]


def search_segment(
    segment: Segment, units: list[Unit], least: int, k: int, scores_at: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of all documents whose score is `least` or more and may be among the
    k best, and how many postings were looked at. Units whose bounds together stay under
    `least` bring no candidate; they are only looked up for those that the others bring."""
    units = sorted(units)
    rest = split = looked = 0
    while split < len(units) and rest + units[split].bound < least:
        rest += units[split].bound
        split += 1
    for unit in units[split:]:
        for term in unit.terms:
            if term in segment.postings:
                docs, impacts = segment.postings[term]
                scores_at[docs] += impacts
                looked += len(docs)
    docs = np.flatnonzero(scores_at)
    scores = scores_at[docs]
    scores_at[docs] = 0
    for unit in reversed(units[:split]):
        if len(scores) >= k:
            least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        able = scores + rest >= least
        docs, scores = docs[able], scores[able]
        if not len(docs):
            break
        rest -= unit.bound
        looked += len(docs)
        if unit.pair < 0:
            hit, impacts = looked_up(segment.postings.get(unit.terms[0]), docs)
            scores[hit] += impacts
            continue
        hit, impacts = looked_up(segment.joint.get(unit.pair), docs)
        scores[hit] += impacts
        # outside the intersection a document has one of the terms at most
        able = hit | (scores + rest + unit.single >= least)
        docs, scores, hit = docs[able], scores[able], hit[able]
        alone = np.flatnonzero(~hit)
        looked += len(alone)
        for term in unit.terms:
            there, impacts = looked_up(segment.postings.get(term), docs[alone])
            scores[alone[there]] += impacts
    able = scores >= least
    return docs[able], scores[able], looked


def segments_of(batches: Iterable[pa.RecordBatch], block: Block) -> Iterator[Segment]:
    """The segments of INDEX rows that come segment by segment."""
    now, name = None, None
    for batch in batches:
        names, terms, pairs, most = (batch.column(k).to_pylist() for k in range(4))
        ends = [batch.column(k).offsets.to_numpy() for k in (4, 5)]
        flat = [batch.column(k).values.to_numpy() for k in (4, 5)]
        ids = batch.column(6)
        for k, own in enumerate(names):
            if own != name:
                if now is not None:
                    yield now
                now, name = Segment(len(block.weights), len(block.pairs)), own
            lists = tuple(x[e[k] : e[k + 1]].copy() for x, e in zip(flat, ends, strict=True))
            if terms[k] is not None:
                now.postings[terms[k]] = lists
                now.most[terms[k]] = most[k]
            elif pairs[k] is not None:
                now.joint[pairs[k]] = lists
                now.joint_most[pairs[k]] = most[k]
            else:
                docs = ids[k].values
                now.nulls = np.asarray(docs.is_null())
                now.docs = docs.fill_null(0).to_numpy()
    if now is not None:
        yield now


def search(index: DataFrame, block: Block, k: int) -> DataFrame:
    """The k best documents of each item in each partition: (item, item_id, doc_id, score).

    A partition goes through its segments one after the other, so the k-th best score so far
    is what the next one must reach.
    """
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        none = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
        best = [none] * len(own.ids)  # ids, which of them are null, scores
        for segment in segments_of(batches, own):
            scores_at = np.zeros(len(segment.docs), np.int64)
            for item, (order, links) in enumerate(zip(own.orders, own.links, strict=True)):
                ids, nulls, scores = best[item]
                least = int(scores[-1]) if len(scores) == k else 1
                docs, found, _ = search_segment(segment, units_of(order, links, segment), least, k, scores_at)
                if len(docs):
                    ids = np.concatenate([ids, segment.docs[docs]])
                    nulls = np.concatenate([nulls, segment.nulls[docs]])
                    scores = np.concatenate([scores, found])
                    top = np.lexsort((ids, nulls, -scores))[:k]
                    best[item] = (ids[top], nulls[top], scores[top])
        at = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        if len(at):
            ids, nulls, scores = (np.concatenate([b[x] for b in best]) for x in range(3))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(at, pa.int32()),
                    pa.array([own.ids[i] for i in at], pa.int64()),
                    pa.array(ids, pa.int64(), mask=nulls),
                    pa.array(scores, pa.int64()),
                ],
                names=["item", "item_id", "doc_id", "score"],
            )

    dealt = index.repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of each id, of all its rows together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(raw))) for raw in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"]
            )

    each = items.mapInArrow(run, "item_id long, terms array<binary>")
    return each.select("item_id", F.explode("terms").alias("term")).distinct().groupBy("item_id").agg(
        F.sort_array(F.collect_list("term")).alias("terms")
    )


def block_of(items: list[tuple[int | None, list[bytes]]], weight: dict[bytes, int], terms: list[bytes]) -> Block:
    """The items of a block, their terms ordered, and the pairs of neighbours."""
    at = {t: k for k, t in enumerate(terms)}
    weights = np.array([weight[t] for t in terms], np.int64)
    pairs: dict[tuple[int, int], int] = {}
    orders, links = [], []
    for _, own in items:
        order = sorted((at[t] for t in own), key=lambda t: (-weights[t], t))
        orders.append(np.array(order, np.int64))
        links.append(
            np.array([pairs.setdefault(p, len(pairs)) for p in zip(order, order[1:], strict=False)], np.int64)
        )
    return Block([i for i, _ in items], orders, links, weights, np.array(list(pairs), np.int64).reshape(-1, 2))


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """The k best documents of each item: (item_id, rank, doc_id, score).

    Items are taken in blocks whose terms have a bounded size. For a block the texts are
    read once; the index holds the lists of the block's terms and of its term pairs for all
    documents, in segments, and every item is ranked against every segment. Scores are
    whole numbers; equal ones rank by ascending id, null last. An item's terms count once,
    and the rows of one item_id (also the null one) are one item. Null and empty texts hold
    no term and rank nowhere; rows that repeat are ranked each. Empty tables give no rows.
    """
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    known = saved(
        item_terms(items.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text_column).alias("text")))
    )
    size = known.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 40)))
    blocks = -(-(size.first()[0] or 0) // BLOCK_BYTES)
    out = [docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for b in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # BLOCK_BYTES or so
        own = sorted(((r["item_id"], [bytes(t) for t in r["terms"]]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0))
        out.append(_ranked_block(narrow, own, k))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def _ranked_block(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    terms = sorted(set().union(*(own for _, own in items)))
    forward = saved(forward_rows(docs, terms))
    total = forward.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("length")).first()
    # one row for each of the block's terms
    counts = forward.select(F.explode("ids").alias("id")).groupBy("id").count().collect()
    df = {terms[r["id"]]: r["count"] for r in counts}
    n = total["docs"]
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in terms}
    block = block_of(items, weight, terms)
    index = saved(index_rows(forward, block, n, max(1, total["length"] or 0)))
    rank = F.row_number().over(
        W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    )
    found = saved(search(index, block, k))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = (
    "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP12_SQL = f"""
WITH d AS (SELECT doc_id, unnest({_SPLIT.format("text")}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM size),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, total GROUP BY term, docs),
item AS (SELECT DISTINCT item_id, unnest({_SPLIT.format("text")}) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score
  FROM item JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), total
  GROUP BY item_id, doc_id),
placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
         doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM placed WHERE rank <= 10
"""
