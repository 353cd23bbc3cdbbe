"""Memory of Python workers that build large arrays."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import pyarrow as pa

#: Arrays from this size on go back to the system as soon as they are dropped.
RETURNED = 1 << 20
#: The fixed number of the C library's setting for that size.
_MMAP_THRESHOLD = -3


@lru_cache(maxsize=1)
def lean() -> None:
    """Makes this worker process give back what it frees, instead of keeping it for later; a C library without the setting is left as it is."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(_MMAP_THRESHOLD, RETURNED)
    except (OSError, AttributeError):
        pass
