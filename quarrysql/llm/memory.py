"""What a Python worker keeps between tasks: for one operator at a time, bounded by bytes.

Workers outlive tasks, stages and operators. What an operator keeps stays while its own tasks come;
the first task of another operator gives it up, so caches of several operators never add up.
"""

from __future__ import annotations

import ctypes
import gc
import resource
import sys
from collections.abc import Callable

import pyarrow as pa

#: About what an entry of a dict takes besides the data of its key and value.
ENTRY = 140
#: Resident bytes up to which a worker is left as it is.
LEAN = 240 << 20
_KEPT: dict[tuple[str, str], object] = {}


def of_worker(operator: str, name: str, make: Callable[[], object]):
    """What this worker keeps for an operator under a name."""
    found = _KEPT.get((operator, name))
    if found is None:
        if any(key[0] != operator for key in _KEPT):
            _KEPT.clear()
            release()
        found = _KEPT[operator, name] = make()
    return found


def _resident() -> int:
    """Bytes of memory that this process has; unknown ones count as many."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize()
    except OSError:
        return LEAN + 1


def release() -> None:
    """Gives memory that is free inside this process back to the system, if it has more than a worker
    needs to stand by."""
    if _resident() <= LEAN:
        return
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


class Cache(dict):
    """Two generations of about ``most`` bytes together: when the young one is full it becomes the old
    one, so memory is bounded and what is in use stays."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.size, self.old = most // 2, 0, {}

    def put(self, key, value, size: int):
        """Keeps a value of so many bytes, its key's included."""
        self[key] = value
        self.size += size + ENTRY
        return value

    def put_all(self, found: dict, size: int) -> None:
        """Keeps values of so many bytes together, their keys' included."""
        self.update(found)
        self.size += size + ENTRY * len(found)

    def age(self) -> None:
        if self.size >= self.most:
            self.old, self.size = dict(self), 0
            self.clear()
