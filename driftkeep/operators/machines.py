"""State machines of the order-dependent policies, shared by batch and streaming runs.

``offer(pos, item_id, payload)`` returns (accepted, score at insertion, position
evicted or None). Positions are unique and ascending within a stream.
"""

from __future__ import annotations

import heapq
from operator import eq
from typing import Protocol

import numpy as np

AGGREGATORS = ("min", "max", "mean", "median", "jaccard")


def _median(n: list[int]) -> float:
    n, half = sorted(n), len(n) // 2
    return n[half] if len(n) % 2 else (n[half - 1] + n[half]) / 2


_FOLDS = {"min": min, "max": max, "mean": lambda n: sum(n) / len(n), "median": _median}


def check_aggregator(name: str) -> None:
    if name not in AGGREGATORS:
        raise ValueError(f"unknown aggregator: {name}")


class Machine(Protocol):
    def offer(self, pos: int, item_id: int, payload) -> tuple[bool, float, int | None]: ...


class BucketOccupancy:
    """Keep what falls into thinly occupied buckets; evict what was most crowded when it came.

    id_mode "pos" keys entries by position. "source" keys them by item id: a
    repeated id replaces its entry while its old bucket counts and its old
    place in the queue remain.
    """

    def __init__(self, capacity: int, aggregator: str, threshold: float | None = None, id_mode: str = "pos"):
        self.capacity, self.aggregator, self.threshold, self.by_source = capacity, aggregator, threshold, id_mode == "source"
        self.entries: dict[int, tuple[int, float, list[int]]] = {}
        self.counts: dict[int, int] = {}
        self.members: dict[int, set[int]] = {}
        self.queue: list[tuple[float, int]] = []

    def occupancy(self, buckets: list[int]) -> float:
        if self.aggregator == "jaccard":
            near: set[int] = set().union(*(self.members.get(b, ()) for b in buckets))
            best = 0.0
            for k in near:
                m = sum(map(eq, self.entries[k][2], buckets))
                best = max(best, m / (2 * len(buckets) - m))
            return best
        get = self.counts.get
        return float(_FOLDS[self.aggregator]([get(b, 0) for b in buckets]))

    def _forget(self, k: int, buckets: list[int]) -> None:
        for b in buckets:
            at = self.members[b]
            at.discard(k)
            if not at:
                del self.members[b]

    def _evict(self) -> int | None:
        while self.queue:
            _, k = heapq.heappop(self.queue)
            if k in self.entries:
                pos, _, buckets = self.entries.pop(k)
                for b in buckets:
                    n = self.counts[b] - 1
                    if n:
                        self.counts[b] = n
                    else:
                        del self.counts[b]
                if self.aggregator == "jaccard":
                    self._forget(k, buckets)
                return pos
        return None

    def _keep(self, pos: int, item_id: int, occ: float, buckets: list[int]) -> None:
        k = item_id if self.by_source else pos
        if self.aggregator == "jaccard":
            if k in self.entries:
                self._forget(k, self.entries[k][2])
            for b in buckets:
                self.members.setdefault(b, set()).add(k)
        self.entries[k] = (pos, occ, buckets)
        for b in buckets:
            self.counts[b] = self.counts.get(b, 0) + 1
        heapq.heappush(self.queue, (-occ, k))

    def offer(self, pos: int, item_id: int, payload) -> tuple[bool, float, int | None]:
        # A bucket and its table as one number.
        buckets = [t << 48 | int(b) for t, b in enumerate(payload)]
        occ, evicted = self.occupancy(buckets), None
        full = len(self.entries) >= self.capacity
        if self.threshold is not None:
            if occ >= self.threshold:
                return False, occ, None
        elif full and not occ < -self.queue[0][0]:
            return False, occ, None
        if full:
            evicted = self._evict()
        self._keep(pos, item_id, occ, buckets)
        return True, occ, evicted


class SemanticDedup:
    """Keep what isn't too similar to anything kept, until full."""

    def __init__(self, capacity: int, epsilon: float):
        self.capacity, self.limit = capacity, 1 - epsilon
        self.rows, self.n = np.empty((0, 0)), 0

    def offer(self, pos: int, item_id: int, payload) -> tuple[bool, float, int | None]:
        v = np.asarray(payload, np.float64)
        if self.n >= self.capacity:
            return False, 0.0, None
        best = float((self.rows[: self.n] @ v).max()) if self.n else 0.0
        if self.n and best > self.limit:
            return False, best, None
        if self.n == len(self.rows):
            # Room doubles, up to the capacity.
            self.rows = np.concatenate([self.rows.reshape(-1, len(v)), np.empty((min(max(16, self.n), self.capacity - self.n), len(v)))])
        self.rows[self.n] = v
        self.n += 1
        return True, best, None


class ReplacingReservoir:
    """Fill, then replace a random slot with probability B / seen."""

    def __init__(self, capacity: int, seed: int):
        self.capacity, self.seen, self.slots, self.random = capacity, 0, [], np.random.RandomState(seed)

    def offer(self, pos: int, item_id: int, payload) -> tuple[bool, float, int | None]:
        self.seen += 1
        if len(self.slots) < self.capacity:
            self.slots.append(pos)
            return True, 0.0, None
        j = int(self.random.randint(0, self.seen))
        if j >= self.capacity:
            return False, 0.0, None
        evicted, self.slots[j] = self.slots[j], pos
        return True, 0.0, evicted
