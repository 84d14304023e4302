"""Ranges of positions that cover a set of places, for scans to prune by."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.operators.columns import bin_of, bin_width
from siteweave.schema import BIN

# Pruning by a set of places: the most ranges in one filter, the bases of a stretch whose
# places are put together before that, and the most stretches that are looked at.
MOST_RANGES = 64
STRETCH = 1 << 20
MOST_STRETCHES = 20_000


class Coordinate(NamedTuple):
    reference_name: str
    start_position: int
    end_position: int


def covering_ranges(
    places: DataFrame, start: str, end: str, most: int = MOST_RANGES
) -> list[Coordinate] | None:
    """At most `most` ranges that hold every place of (reference_name, start, end), or None if
    the places are on too many chromosomes for that.

    One aggregation by chromosome and stretch of a megabase; its rows are bounded by the
    genome's length (and cut at MOST_STRETCHES, beyond which whole chromosomes are taken).
    Ranges meet where the gaps between them are smallest.
    """
    span = [F.min(start).alias("start_position"), F.max(end).alias("end_position")]
    known = places.where(F.col(start).isNotNull() & F.col(end).isNotNull() & F.col("reference_name").isNotNull())
    by_stretch = known.groupBy("reference_name", bin_of(F.col(start), STRETCH).alias("stretch"))
    rows = by_stretch.agg(*span).limit(MOST_STRETCHES + 1).collect()
    if len(rows) > MOST_STRETCHES:
        rows = known.groupBy("reference_name").agg(*span).limit(most + 1).collect()
    found = sorted((r["reference_name"], r["start_position"], r["end_position"]) for r in rows)
    chromosomes = {name for name, _, _ in found}
    if len(chromosomes) > most:
        return None
    # overlapping stretches become one, then the smallest gaps are closed
    ranges: list[Coordinate] = []
    for name, low, high in found:
        last = ranges[-1] if ranges else None
        if last and last.reference_name == name and low <= last.end_position + 1:
            ranges[-1] = Coordinate(name, last.start_position, max(high, last.end_position))
        else:
            ranges.append(Coordinate(name, low, high))
    pairs = zip(ranges, ranges[1:], strict=False)
    gaps = [(b.start_position - a.end_position, k) for k, (a, b) in enumerate(pairs) if a.reference_name == b.reference_name]
    closed = {k for _, k in sorted(gaps)[: max(0, len(ranges) - most)]}
    out: list[Coordinate] = []
    for k, own in enumerate(ranges):
        out.append(Coordinate(own.reference_name, out.pop().start_position, own.end_position) if k - 1 in closed else own)
    return out


def starts_in_ranges(df: DataFrame, ranges: list[Coordinate]) -> Column:
    """Whether a variant starts inside one of the ranges, in clauses that a scan can prune by:
    chromosome, position and, where their width is known, bins."""
    width = bin_width(df)

    def inside(r: Coordinate) -> Column:
        clause = F.col("start_position").between(r.start_position, r.end_position)
        if width:
            clause &= F.col(BIN).between(bin_of(r.start_position, width), bin_of(r.end_position, width))
        return clause

    def any_of(clauses: list[Column]) -> Column:
        # halves, so that the condition is as deep as the logarithm of their number
        if len(clauses) < 2:
            return clauses[0] if clauses else F.lit(False)
        half = len(clauses) // 2
        return any_of(clauses[:half]) | any_of(clauses[half:])

    by_name: dict[str, list[Column]] = {}
    for r in ranges:
        by_name.setdefault(r.reference_name, []).append(inside(r))
    return any_of([(F.col("reference_name") == name) & any_of(own) for name, own in by_name.items()])
