"""Benchmark decontamination by spaced seeds, verified with room for substitutions."""

import string
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm.common import mixed, pieces, table, texts_of, word_hashes

#: An overlap is a window of WINDOW aligned words of which at most SUBSTITUTED differ. An item
#: of fewer words is one window with room in proportion; one of under WHOLE words, which
#: ordinary text would hit, must be there without a change.
WINDOW = 13
SUBSTITUTED = 2
WHOLE = 8
#: Positions that each mask looks at. Wherever two words of a window of 13 are replaced, one of
#: these fits into it beside them (a test tries all 78 cases), so no overlap lacks a seed.
MASKS = ((0, 1, 2, 3, 4, 6, 7), (0, 1, 4, 6, 8, 9, 10), (0, 1, 3, 7, 8, 9, 10))
#: Benchmark words that go to the executors at once. A larger benchmark takes several passes.
PASS_WORDS = 2_000_000

_UPPER = string.ascii_uppercase.encode()
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_PUNCTUATION = string.punctuation.encode()


def plain_words(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased and ASCII punctuation taken out."""
    return text.translate(_LOWER, _PUNCTUATION).split() if text else []


def window_of(length: int) -> tuple[int, int]:
    """Width and permitted substitutions for an item of so many words."""
    width = min(WINDOW, length)
    return width, SUBSTITUTED * width // WINDOW if width >= WHOLE else 0


def masks_of(length: int) -> tuple[tuple[int, ...], ...]:
    """The masks for an item: the spaced ones, or for a short item the blocks of which one
    must be free of substitutions."""
    width, changed = window_of(length)
    if width == WINDOW:
        return MASKS
    return (tuple(range(width // (changed + 1))),)


def seeds_of(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of what the mask sees at each position."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    seed = np.full(n, len(mask) << 8 | mask[-1], np.uint64)
    for offset in mask:
        seed = seed * np.uint64(0x9E3779B97F4A7C15) + words[offset : offset + n]
    return mixed(seed)


class Index(NamedTuple):
    """Seeds of one pass over the benchmark, ascending, with the items they come from."""

    masks: list[tuple[int, ...]]
    seeds: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    there: np.ndarray  # by the seed's first bits
    ids: list[int]
    words: list[np.ndarray]


BITS = 22


def index_of(rows: list[tuple[int, bytes | None]]) -> Index:
    ids, words, masks, parts = [], [], {}, []
    for item_id, text in rows:
        own = word_hashes(plain_words(text))
        if not len(own):
            continue
        for mask in masks_of(len(own)):
            masks[mask] = True
            seeds = seeds_of(own, mask)
            parts.append((seeds, np.full(len(seeds), len(ids), np.int64), np.arange(len(seeds), dtype=np.int64)))
        ids.append(item_id)
        words.append(own)
    seeds, items, offsets = (
        (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, t) for t in ("u8", "i8", "i8"))
    )
    order = np.argsort(seeds, kind="stable")
    there = np.zeros(1 << BITS, bool)
    there[(seeds >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return Index(list(masks), seeds[order], items[order], offsets[order], there, ids, words)


def diagonals(words: np.ndarray, index: Index) -> np.ndarray:
    """Distinct (item, shift) where a seed of the text meets one of an item."""
    found = []
    for mask in index.masks:
        seeds = seeds_of(words, mask)
        at = np.flatnonzero(index.there[(seeds >> np.uint64(64 - BITS)).astype(np.int64)])
        low = np.searchsorted(index.seeds, seeds[at], "left")
        times = np.searchsorted(index.seeds, seeds[at], "right") - low
        if times.any():
            place = np.repeat(at, times)
            entry = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
            found.append(np.stack([index.items[entry], place - index.offsets[entry]], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def overlaps_of(text: bytes | None, index: Index) -> list[tuple[int, int, int, int]]:
    """(item_id, first_word, n_windows, matched) of a text: where the first window begins,
    how many windows overlap, and the most words that agree in one."""
    words = word_hashes(plain_words(text))
    best: dict[int, tuple[int, int, int]] = {}
    for item, shift in diagonals(words, index):
        own = index.words[item]
        width, changed = window_of(len(own))
        start, end = max(0, -shift), min(len(own), len(words) - shift)
        if end - start < width:
            continue
        same = np.concatenate([[0], np.cumsum(own[start:end] == words[start + shift : end + shift])])
        agree = same[width:] - same[:-width]
        hits = np.flatnonzero(agree >= width - changed)
        if len(hits):
            first, n, most = int(hits[0] + start + shift), len(hits), int(agree[hits].max())
            f, k, m = best.get(item, (first, 0, 0))
            best[item] = (min(f, first), k + n, max(m, most))
    return [(index.ids[item], *found) for item, found in sorted(best.items())]


def passes(benchmark: DataFrame, id_column: str, text_column: str) -> list[Broadcast]:
    """The benchmark's seeds in passes of about PASS_WORDS words, each sent on its own."""
    narrow = benchmark.select(
        F.col(id_column).cast("long").alias("id"), F.encode(text_column, "UTF-8").alias("raw")
    ).where("raw is not null")
    size = narrow.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    number = max(1, -(-size // (6 * PASS_WORDS)))
    sent = []
    for k in range(number):
        part = narrow.where(F.pmod(F.xxhash64("id", "raw"), F.lit(number)) == k)
        rows = sorted(((r["id"], bytes(r["raw"])) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        sent.append(benchmark.sparkSession.sparkContext.broadcast(tuple(index_of(rows))))
    return sent


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Overlaps of documents with benchmark items, one row per document and item.

    Words lose case (A-Z) and ASCII punctuation. Masks that skip fixed positions give seeds
    of both sides; where seeds meet, the two word sequences are laid over each other and
    each window of 13 words is counted. A window overlaps if at most 2 words differ. Texts
    are searched whole; nothing is shuffled, and the benchmark travels in bounded passes.

    Items of under 8 words overlap where they stand whole and unchanged.

    Returns doc_id, item_id, first_word, n_windows, matched. Null texts and items and those
    without words match nothing; repeated rows, equal items and items without id match each
    on its own.
    """
    frames = []
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    for sent in passes(benchmark, item_column, item_text_column):

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names = ["doc_id", "item_id", "first_word", "n_windows", "matched"]
            index = Index(*sent.value)
            for piece in (p for batch in batches for p in pieces(batch, 1)):
                ids = piece.column(0).to_pylist()
                texts = texts_of(piece.column(1))
                rows = [(i, *o) for i, t in zip(ids, texts, strict=True) for o in overlaps_of(t, index)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64()] * 2 + [pa.int32()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        frames.append(
            narrow.mapInArrow(run, "doc_id long, item_id long, first_word int, n_windows int, matched int")
        )
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """The rows of `docs` whose text overlaps no benchmark item, all columns as they are."""
    at = docs.columns.index(text_column)
    for sent in passes(benchmark, item_column, item_text_column):

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(*sent.value)
            for piece in (p for batch in batches for p in pieces(batch, at)):
                clean = [not overlaps_of(t, index) for t in texts_of(piece.column(at))]
                yield piece.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with the benchmark."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CASE = r"""'ABCDEFGHIJKLMNOPQRSTUVWXYZ!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', 'abcdefghijklmnopqrstuvwxyz'"""

#: Lays every document over every item at every shift and counts each window.
OP10_SQL = rf"""
WITH dw AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p, len(w) AS n FROM (
    SELECT doc_id, regexp_extract_all(translate(text, {_CASE}), '[^\x20\x09-\x0D]+') AS w FROM documents)),
bw AS (
  SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS q, len(w) AS m, least(len(w), 13) AS width FROM (
    SELECT item_id, regexp_extract_all(translate(text, {_CASE}), '[^\x20\x09-\x0D]+') AS w FROM benchmark)
  WHERE len(w) > 0),
same AS (
  SELECT doc_id, item_id, p - q AS shift, q, n, m, width FROM dw JOIN bw USING (word)),
ends AS (
  SELECT doc_id, item_id, shift, q, n, m, width, count(*) OVER (
      PARTITION BY doc_id, item_id, shift ORDER BY q RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS near
  FROM same),
spots AS (
  SELECT DISTINCT doc_id, item_id, shift, n, m, width, unnest(range(greatest(0, -shift, q - width + 1),
      least(q, m - width, n - shift - width) + 1)) AS start
  FROM ends WHERE near >= width - CASE WHEN width < 8 THEN 0 ELSE (2 * width) // 13 END),
windows AS (
  SELECT s.doc_id, s.item_id, s.shift, s.start, s.width, count(*) AS agree
  FROM spots s JOIN same e ON s.doc_id = e.doc_id AND s.item_id = e.item_id AND s.shift = e.shift
      AND e.q BETWEEN s.start AND s.start + s.width - 1
  GROUP BY ALL HAVING count(*) >= s.width - CASE WHEN s.width < 8 THEN 0 ELSE (2 * s.width) // 13 END)
SELECT doc_id, item_id, CAST(min(shift + start) AS INTEGER) AS first_word,
  CAST(count(*) AS INTEGER) AS n_windows, CAST(max(agree) AS INTEGER) AS matched
FROM windows GROUP BY doc_id, item_id
"""
