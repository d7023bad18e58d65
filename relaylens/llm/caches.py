"""One operator's caches at a time in a Python worker.

Workers live as long as their executor and serve every operator in turn.  An
operator's task claims the worker for its caches, which drops those of the
operator before; the next task of the same operator finds its own still
there.  So a pipeline needs the memory of its largest stage, not of all.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

_CLEAR: dict[str, Callable[[], None]] = {}
_OWNER: list[str] = []


def register(name: str, clear: Callable[[], None]) -> None:
    _CLEAR[name] = clear


def claim(name: str) -> None:
    """Called where a task begins."""
    if _OWNER == [name]:
        return
    for other, clear in _CLEAR.items():
        if other != name:
            clear()
    _OWNER[:] = [name]
    gc.collect()
