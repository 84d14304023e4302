"""Row filters over variant tables."""

import operator
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.functions.alternates import is_copy_number
from siteweave.operators.columns import bin_of, bin_width, level_width, level_widths
from siteweave.schema import BIN, LEVEL, LEVELS

COMPARE = {
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
    "=": operator.eq,
    "<>": operator.ne,
}

# What a legal argument looks like. An alternate may be a list, and symbolic.
BASES = re.compile(r"[ACTG]*")
ALTERNATES = re.compile(r"([ACTG]*|[*.]|<[A-Za-z0-9:_.-]+>)(,([ACTG]+|[*.]|<[A-Za-z0-9:_.-]+>))*")
CONTIG = re.compile(r"[A-Za-z0-9_.*:-]+")
MAX_POSITION = 2**63 - 1


@dataclass(frozen=True)
class VariantFilter:
    """What to keep; every clause that is given must hold.

    With `position_range` the variant's *start* must lie between the two positions,
    both included. Without it the start and the end are each compared by their own
    operator.
    """

    reference_name: str | None = None
    start_position: int | None = None
    end_position: int | None = None
    position_range: bool = True
    start_operator: str = "="
    end_operator: str = "="
    reference_bases: str | None = None
    alternate_bases: str | None = None
    rsid: str | None = None
    minor_af: float | None = None
    minor_af_margin: float | None = None

    def __post_init__(self):
        if self.reference_name is not None and not CONTIG.fullmatch(self.reference_name):
            raise ValueError(f"no reference name: {self.reference_name!r}")
        for name in ("start_position", "end_position"):
            value = getattr(self, name)
            if value is not None and (
                not isinstance(value, int)
                or isinstance(value, bool)
                or not -MAX_POSITION - 1 <= value <= MAX_POSITION
            ):
                raise ValueError(f"{name} must be a 64-bit integer, not {value!r}")
        for name, legal in (("reference_bases", BASES), ("alternate_bases", ALTERNATES)):
            value = getattr(self, name)
            if value is not None and not legal.fullmatch(value):
                raise ValueError(f"{name} must consist of bases, not {value!r}")
        for name in ("start_operator", "end_operator"):
            if getattr(self, name) not in COMPARE:
                raise ValueError(f"{name} must be one of {list(COMPARE)}")
        if self.minor_af_margin is not None and not 0 <= self.minor_af_margin <= 1:
            raise ValueError("minor_af_margin must lie between 0 and 1")

    def clauses(self, width: int | None = None) -> list[Column]:
        """The clauses as columns; `width` adds the matching bin clauses."""
        kept: list[Column] = []
        if self.reference_name is not None:
            kept.append(F.col("reference_name") == self.reference_name)
        kept += self._positions(width)
        for name in ("reference_bases", "alternate_bases"):
            if getattr(self, name) is not None:
                kept.append(F.col(name) == getattr(self, name))
        if self.rsid is not None:
            kept.append(F.col("id") == self.rsid)
        if self.minor_af is not None:
            spread = self.minor_af * (self.minor_af_margin or 0.0)
            kept.append(
                F.col("minor_af").between(
                    F.lit(self.minor_af - spread), F.lit(self.minor_af + spread)
                )
            )
        return kept

    def _positions(self, width: int | None) -> list[Column]:
        start, end = self.start_position, self.end_position
        if start is None and end is None:
            return []
        kept = []
        if self.position_range:
            low = 0 if start is None else start
            kept.append(F.col("start_position") >= low)
            bounds = {">=": low}
            if end is not None:
                kept.append(F.col("start_position") <= end)
                bounds["<="] = end
        else:
            bounds = {}
            if start is not None:
                kept.append(COMPARE[self.start_operator](F.col("start_position"), start))
                bounds[self.start_operator] = start
            if end is not None:
                kept.append(COMPARE[self.end_operator](F.col("end_position"), end))
        if width:
            # Catalyst prunes bins but cannot derive their clause from the position.
            for op, value in bounds.items():
                at = bin_of(value, width)
                if op in (">", ">=", "="):
                    kept.append(F.col(BIN) >= at)
                if op in ("<", "<=", "="):
                    kept.append(F.col(BIN) <= at)
        return kept


def filter_variants(
    df: DataFrame, where: VariantFilter, width: int | None = None
) -> DataFrame:
    """Rows that meet every clause of the filter; no clause keeps every row.

    Bin clauses are added when the table's bins have a known width.
    """
    clauses = where.clauses(width if width and BIN in df.columns else bin_width(df))
    return df.where(reduce(operator.and_, clauses)) if clauses else df


def filter_any(
    df: DataFrame, wheres: list[VariantFilter], width: int | None = None
) -> DataFrame:
    """Rows that meet any of the filters, in one scan; a filter without clauses keeps all."""
    width = width if width and BIN in df.columns else bin_width(df)
    each = [where.clauses(width) for where in wheres]
    if not all(each):
        return df
    return df.where(reduce(operator.or_, [reduce(operator.and_, clauses) for clauses in each]))


def filter_overlap(df: DataFrame, reference_name: str, start: int, end: int) -> DataFrame:
    """Variants whose interval shares a position with [start, end].

    Where the table has levels (`with_level`), each level bounds the start from below by its
    width, so that a scan of the layout skips what begins too far away.
    """
    found = df.where(
        (F.col("reference_name") == reference_name)
        & (F.col("start_position") <= end)
        & (F.col("end_position") >= start)
    )
    width = level_width(df)
    if width is None:
        return found
    near = [
        (F.col(LEVEL) == k) & (F.col("start_position") > start - w) for k, w in enumerate(level_widths(width))
    ]
    return found.where(reduce(operator.or_, near, F.col(LEVEL) == LEVELS))


def filter_contained(
    df: DataFrame,
    reference_name: str | None = None,
    start: int | None = None,
    end: int | None = None,
    reference_bases: str | None = None,
    alternate_bases: str | None = None,
    position_range: bool = True,
) -> DataFrame:
    """Variants that start at or after `start` and end at or before `end`.

    Without `position_range` both positions must be equal to the given ones.
    """
    where = VariantFilter(
        reference_name=reference_name,
        start_position=start,
        end_position=end,
        position_range=False,
        start_operator=">=" if position_range else "=",
        end_operator="<=" if position_range else "=",
        reference_bases=reference_bases,
        alternate_bases=alternate_bases,
    )
    return filter_variants(df, where)


def filter_snp(df: DataFrame) -> DataFrame:
    """One reference base and one alternate base."""
    return df.where(
        (F.length("reference_bases") == 1) & (F.length("alternate_bases") == 1)
    )


def drop_copy_number(df: DataFrame) -> DataFrame:
    """Drop variants whose alternate is a copy number."""
    return df.where(~is_copy_number(F.col("alternate_bases")))


def filter_population(df: DataFrame, populations: str | list[str]) -> DataFrame:
    """Keep the named superpopulations (a list or a comma list) of a long table."""
    names = populations.split(",") if isinstance(populations, str) else populations
    return df.where(F.col("superpopulation").isin(list(names)))


def filter_carried(df: DataFrame, count_column: str) -> DataFrame:
    """Rows whose count is above zero."""
    return df.where(F.col(count_column) > 0)
