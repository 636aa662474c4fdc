"""A place in each Python worker that outlives a task. Code travels to workers by value, so its globals do not.

A worker serves one operator after the other, so what one kept is dropped when another asks.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types

import pyarrow as pa

_NAME = "_chalkstream_worker"


def store(owner: str) -> dict:
    kept = sys.modules.setdefault(_NAME, types.ModuleType(_NAME)).__dict__.setdefault("kept", {})
    others = [o for o in kept if o != owner]
    for other in others:
        del kept[other]
    if others:
        give_back()
    return kept.setdefault(owner, {})


def give_back() -> None:
    """Free memory goes back to the system, for the operators that come after in the same worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library
