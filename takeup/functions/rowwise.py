"""Row-wise statistics over many columns held in one array.

Build the array from bare columns in its own projection and derive everything
from it: wrapping each of thousands of columns in an expression is several times
slower than one higher-order function over the array.
"""

from __future__ import annotations

from collections.abc import Sequence

FINITE = "abs(v) < double('Infinity')"


def values_of(cols: Sequence[str]) -> str:
    return f"cast(array({', '.join(f'`{c}`' for c in cols)}) as array<double>)"


def valid(values: str) -> str:
    """Drop null, NaN and infinite entries."""
    return f"filter({values}, v -> {FINITE})"


def zero_filled(values: str) -> str:
    return f"transform({values}, v -> CASE WHEN {FINITE} THEN v ELSE 0.0D END)"


def total(values: str) -> str:
    return f"aggregate({values}, 0.0D, (acc, v) -> acc + v)"


def nonzero(values: str) -> str:
    return f"size(filter({values}, v -> v != 0))"


def mean_present(values: str) -> str:
    """Mean of the entries of an array without nulls; null when it is empty."""
    return f"try_divide({total(values)}, size({values}))"


def spread(values: str, mean: str, width: int | None = None) -> str:
    """Population standard deviation in two passes. With ``width``, entries
    missing from ``values`` up to that many count as zero."""
    squares = f"aggregate({values}, 0.0D, (acc, v) -> acc + (v - {mean}) * (v - {mean}))"
    if width is None:
        return f"sqrt(try_divide({squares}, size({values})))"
    return f"sqrt(({squares} + ({width} - size({values})) * {mean} * {mean}) / {width})"


def quantile(sorted_values: str, size: int, q: float) -> str:
    """Linear interpolation at ``q * (size - 1)`` of a sorted array."""
    position = q * (size - 1)
    low = int(position)
    share = position - low
    a = f"{sorted_values}[{low}]"
    return a if share == 0.0 else f"({a} + ({sorted_values}[{low + 1}] - {a}) * {share!r}D)"


def descending_ranks(values: str) -> str:
    """0-based rank of every entry, largest first, ties by position: sort the
    positions by value, then sort the ranks by position."""
    keyed = f"transform({values}, (v, i) -> struct(-v as k, i as i))"
    placed = f"transform(sort_array({keyed}), (s, r) -> struct(s.i as i, r as r))"
    return f"transform(sort_array({placed}), s -> s.r)"
