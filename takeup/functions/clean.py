"""Filling, clipping and guarding of single columns (SQL text in, SQL text out)."""

from __future__ import annotations

NULL_LEVEL = "__NA__"


def number(v: float) -> str:
    """Double literal."""
    return f"{float(v)!r}D" if abs(v) != float("inf") else f"double('{'-' if v < 0 else ''}Infinity')"


def finite(c: str) -> str:
    """Value as double with NaN and infinities turned into null."""
    return f"(CASE WHEN abs(cast({c} as double)) < double('Infinity') THEN cast({c} as double) END)"


def fill_category(c: str, default: int = -1) -> str:
    """Integer-coded category, null as its own code."""
    return f"coalesce(cast({c} as int), {default})"


def fill_number(c: str, default: float = 0.0) -> str:
    """Number with null, NaN and infinities replaced."""
    return f"coalesce({finite(c)}, {number(default)})"


def fill_float(c: str, default: float = 0.0) -> str:
    """Single-precision storage form of :func:`fill_number`."""
    return f"cast({fill_number(c, default)} as float)"


def category_level(c: str) -> str:
    """Category as text, null as its own level."""
    return f"coalesce(cast({c} as string), '{NULL_LEVEL}')"


def clip(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {number(low)}), {number(high)})"


def fill_clip(x: str, default: float, low: float | None = None, high: float | None = None) -> str:
    """Null and NaN become ``default``, then the value is clipped. Infinities are
    kept for the clip, as they are legitimate results of an overflow."""
    filled = f"coalesce(nanvl(cast({x} as double), {number(default)}), {number(default)})"
    return filled if low is None else clip(filled, low, high)


def guard(x: str, when_small: str = "1.0D", eps: float = 0.001) -> str:
    """Denominator that is never closer to zero than ``eps``."""
    return f"(CASE WHEN abs({x}) < {number(eps)} THEN {when_small} ELSE {x} END)"


def signed_guard(x: str, eps: float = 0.001) -> str:
    """Denominator pushed away from zero to ``eps``, keeping its sign."""
    return guard(x, f"CASE WHEN {x} >= 0 THEN {number(eps)} ELSE {number(-eps)} END", eps)


def standardised(c: str, mean: float, std: float) -> str:
    """``(x - mean) / std`` with null read as zero; a std below 1e-8 counts as 1."""
    return f"(({fill_number(c)} - {number(mean)}) / {number(std if std >= 1e-8 else 1.0)})"


def null_flag(c: str) -> str:
    return f"cast({finite(c)} IS NULL as int)"


def corrupted(clean: str, was_null: str, draw: str, rate: float) -> str:
    """Zero the cell when it held a value and its draw falls below ``rate``."""
    return f"(CASE WHEN NOT ({was_null}) AND {draw} < {number(rate)} THEN 0.0D ELSE {clean} END)"


def logit(p: str, eps: float = 1e-7) -> str:
    q = clip(p, eps, 1.0 - eps)
    return f"ln({q} / (1.0D - {q}))"


def sigmoid(x: str) -> str:
    return f"(1.0D / (1.0D + exp(-({x}))))"


def asymmetric_log_loss(z: str, y: str, gamma_neg: float = 4.0, gamma_pos: float = 1.0,
                        margin: float = 0.05, eps: float = 1e-8) -> str:
    """Focused log-loss of one logit: easy negatives are shifted by ``margin``
    and damped by the power ``gamma_neg``, easy positives by ``gamma_pos``."""
    p, tiny = sigmoid(z), number(eps)
    shifted = f"greatest({p} - {number(margin)}, {tiny})" if margin > 0 else p
    miss_pos = f"pow(1.0D - {p}, {number(gamma_pos)}) * ln(greatest({p}, {tiny}))"
    miss_neg = f"pow({shifted}, {number(gamma_neg)}) * ln(greatest(1.0D - {shifted}, {tiny}))"
    return f"(-({y} * {miss_pos}) - (1.0D - {y}) * {miss_neg})"
