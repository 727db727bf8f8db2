"""Interval predicates and measures as column expressions.

Two overlap conventions exist side by side and are kept apart by name:
*inclusive* (region queries on stored alignments) and *half-open* (in-memory comparisons).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusweave.schema import FLAG_REVERSE, FLAG_SECONDARY, FLAG_SUPPLEMENTARY, FLAG_UNMAPPED


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def overlaps_inclusive(s1, e1, s2, e2) -> Column:
    return (_c(s1) <= _c(e2)) & (_c(e1) >= _c(s2))


def overlaps_half_open(s1, e1, s2, e2) -> Column:
    return (_c(s1) < _c(e2)) & (_c(e1) > _c(s2))


def overlap_bp(s1, e1, s2, e2) -> Column:
    """Shared length, 0 when disjoint."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2)))


def interval_gap(s1, e1, s2, e2) -> Column:
    """Distance between two intervals, 0 when they overlap or touch."""
    return F.greatest(F.lit(0).cast("bigint"), _c(s2) - _c(e1), _c(s1) - _c(e2))


def iou_bounding(s1, e1, s2, e2) -> Column:
    """Overlap over the bounding span of both intervals; 0 when disjoint."""
    inter = overlap_bp(s1, e1, s2, e2)
    hull = F.greatest(_c(e1), _c(e2)) - F.least(_c(s1), _c(s2))
    return F.when((inter > 0) & (hull > 0), inter / hull).otherwise(F.lit(0.0))


def iou_union(s1, e1, s2, e2) -> Column:
    """Overlap over the true union length; 0 when the union is empty."""
    inter = overlap_bp(s1, e1, s2, e2)
    union = (_c(e1) - _c(s1)) + (_c(e2) - _c(s2)) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def jaccard(shared, n1, n2) -> Column:
    """Set Jaccard from counts; 0 when either set is empty."""
    return F.when(
        (_c(n1) > 0) & (_c(n2) > 0), _c(shared) / (_c(n1) + _c(n2) - _c(shared))
    ).otherwise(F.lit(0.0))


def is_mapped(flag="flag") -> Column:
    return _c(flag).bitwiseAND(FLAG_UNMAPPED) == 0


def is_supplementary(flag="flag") -> Column:
    return _c(flag).bitwiseAND(FLAG_SUPPLEMENTARY) != 0


def is_secondary(flag="flag") -> Column:
    return _c(flag).bitwiseAND(FLAG_SECONDARY) != 0


def is_primary(flag="flag") -> Column:
    return _c(flag).bitwiseAND(FLAG_SECONDARY | FLAG_SUPPLEMENTARY) == 0


def is_reverse(flag="flag") -> Column:
    return _c(flag).bitwiseAND(FLAG_REVERSE) != 0


def usable(include_supplementary: bool = False, flag="flag") -> Column:
    """Mapped records; supplementary ones only on request; secondary ones always kept."""
    keep = is_mapped(flag)
    return keep if include_supplementary else keep & ~is_supplementary(flag)
