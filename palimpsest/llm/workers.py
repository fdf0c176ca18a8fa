"""What a Python worker keeps between tasks, and how it gives memory back.

Workers are reused from task to task and stage to stage.  A vocabulary is worth
keeping for the next task of its own stage, but not while other stages run, so a
worker holds one resident object at most and other operators let go of it.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_resident: dict[str, Any] = {}


def resident(key: str, make: Callable[[], Any]) -> Any:
    """The worker's one kept object, made anew if another was kept."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def tidy() -> None:
    """Let go of what is kept, and hand freed pages back to the system."""
    if _resident:
        _resident.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: pages stay with the worker
        pass
