"""Properties of doubles as SQL."""

from __future__ import annotations

_INFINITE = "double('infinity')"


def is_finite(number: str) -> str:
    """SQL that is true for doubles that are neither NaN nor infinite."""
    return f"(not isnan({number}) and abs({number}) <> {_INFINITE})"
