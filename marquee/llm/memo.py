"""Tables that a Python worker remembers between tasks, of which one is filled at a time.

A worker outlives its task and may serve several stages; a stage that begins to
fill its own table empties the others, so a worker never holds two.
"""

from __future__ import annotations

_tables: list[dict] = []
_filled: dict | None = None


def table() -> dict:
    """A new table."""
    _tables.append({})
    return _tables[-1]


def take(mine: dict) -> None:
    """Empty all tables but this one."""
    global _filled
    if _filled is not mine:
        for other in _tables:
            if other is not mine:
                other.clear()
        _filled = mine
