"""Helpers that tests import by name."""

from __future__ import annotations

from datetime import datetime

START = datetime(2024, 3, 1, 12, 0, 0)


def rows_of(df) -> list[str]:
    """Rows in a form and order that can be compared."""
    columns = sorted(df.columns)
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())
