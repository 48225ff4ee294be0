"""Serving-side caches: least recently used, with an optional time to live."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from threading import Lock
from typing import Any


class LruCache:
    """Holds ``max_size`` entries exactly; entries older than ``ttl`` seconds go when they are asked for."""

    def __init__(self, max_size: int = 1000, ttl: float | None = None, clock: Callable[[], float] = time.monotonic) -> None:
        self._max, self._ttl, self._clock = max_size, ttl, clock
        self._entries: OrderedDict[Any, tuple[Any, float]] = OrderedDict()
        self._lock = Lock()
        self.hits = self.misses = 0

    def get(self, key: Any) -> Any | None:
        with self._lock:
            found = self._entries.get(key)
            if found and self._ttl is not None and self._clock() - found[1] > self._ttl:
                del self._entries[key]
                found = None
            if not found:
                self.misses += 1
                return None
            self._entries.move_to_end(key)
            self.hits += 1
            return found[0]

    def put(self, key: Any, value: Any) -> None:
        with self._lock:
            self._entries[key] = value, self._clock()
            self._entries.move_to_end(key)
            self._trim()

    def _trim(self) -> None:
        while len(self._entries) > max(self._max, 0):
            self._entries.popitem(last=False)

    def clear(self) -> None:
        with self._lock:
            self._entries.clear()
            self.hits = self.misses = 0

    def set_max_size(self, size: int) -> None:
        with self._lock:
            self._max = size
            self._trim()

    def set_ttl(self, ttl: float | None) -> None:
        self._ttl = ttl

    def __len__(self) -> int:
        return len(self._entries)

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"size": len(self), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}
