"""Repeatable pseudo-random numbers from keys.

A hash of the key gives the same draw on every run, partitioning and retry,
which ``rand()`` does not.
"""

from __future__ import annotations


def hash_text(*parts: str | int) -> str:
    """md5 of the parts joined by ``-``; literal text is passed quoted."""
    return f"md5(concat_ws('-', {', '.join(f'cast({p} as string)' for p in parts)}))"


def hash_uniform(*parts: str | int) -> str:
    """Uniform draw in [0, 1) from the first 32 bits of the hash."""
    return f"(cast(conv(substring({hash_text(*parts)}, 1, 8), 16, 10) as bigint) / 4294967296.0D)"
