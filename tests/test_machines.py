"""The state machines against plain restatements of the policies."""

import statistics

import numpy as np
import pytest

from driftkeep.operators.machines import BucketOccupancy, ReplacingReservoir, SemanticDedup, check_aggregator


def naive(sigs, capacity, name, threshold=None):
    kept, log = [], []
    for pos, sig in enumerate(sigs):
        same = [[k[2][t] == sig[t] for t in range(len(sig))] for k in kept]
        if name == "jaccard":
            occ = max((sum(m) / (2 * len(sig) - sum(m)) for m in same if any(m)), default=0.0)
        else:
            n = [sum(m[t] for m in same) for t in range(len(sig))]
            occ = float({"min": min, "max": max, "mean": statistics.fmean, "median": statistics.median}[name](n))
        worst = min(kept, key=lambda k: (-k[1], k[0])) if kept else None
        full = len(kept) >= capacity
        ok = occ < threshold if threshold is not None else not full or occ < worst[1]
        gone = worst[0] if ok and full else None
        if ok:
            kept = [k for k in kept if k[0] != gone] + [(pos, occ, sig)]
        log.append((ok, occ, gone))
    return log


@pytest.mark.parametrize("name", ["min", "max", "mean", "median", "jaccard"])
@pytest.mark.parametrize("threshold", [None, 0.4, 2.0])
def test_occupancy_is_the_policy(name, threshold):
    rng = np.random.default_rng(3)
    sigs = [tuple(x) for x in rng.integers(0, 3, (120, 5)).tolist()]
    for capacity in (1, 7, 200):
        m = BucketOccupancy(capacity, name, threshold)
        got = [m.offer(i, i, s) for i, s in enumerate(sigs)]
        assert got == naive(sigs, capacity, name, threshold)
        assert len(m.entries) <= capacity


def test_ties_evict_the_oldest():
    m = BucketOccupancy(2, "max", threshold=9.0)
    assert [m.offer(i, i, (1, 1))[2] for i in range(4)] == [None, None, 1, 2]


def test_source_ids_replace_their_entry_and_leave_counts():
    m = BucketOccupancy(5, "max", id_mode="source")
    m.offer(0, 7, (1,))
    assert m.offer(1, 7, (1,)) == (True, 1.0, None)
    assert len(m.entries) == 1 and list(m.counts.values()) == [2]


def test_semantic_dedup_keeps_first_of_near_vectors():
    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    m = SemanticDedup(2, 0.1)
    assert [m.offer(i, i, v)[0] for i, v in enumerate([a, a * 0.999, b, a])] == [True, False, True, False]


def test_reservoir_never_exceeds_its_size():
    m = ReplacingReservoir(3, 1)
    live = set()
    for i in range(50):
        ok, _, gone = m.offer(i, i, None)
        live -= {gone}
        live |= {i} if ok else set()
        assert len(live) == min(i + 1, 3)


def test_unknown_aggregator():
    with pytest.raises(ValueError):
        check_aggregator("sum")
