"""Policies by name, with one signature: stream and capacity in, kept rows out.

The stream has pos and item_id, and what the policy looks at: ``sig`` for
bucket occupancy, ``v`` for semantic deduplication; ``key`` tells streams apart
where a policy depends on order. New policies are registered the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from driftkeep.operators import policies

Policy = Callable[..., DataFrame]
_POLICIES: dict[str, Policy] = {}


def register(name: str) -> Callable[[Policy], Policy]:
    def put(policy: Policy) -> Policy:
        if name in _POLICIES:
            raise ValueError(f"{name} is registered already")
        _POLICIES[name] = policy
        return policy

    return put


def names() -> list[str]:
    return sorted(_POLICIES)


def policy(name: str) -> Policy:
    if name not in _POLICIES:
        raise ValueError(f"unknown policy: {name}; there are {', '.join(names())}")
    return _POLICIES[name]


register("oracle")(lambda df, capacity, **_: policies.keep_all(df))
register("fifo")(policies.fifo)
register("freshness")(policies.freshness)
register("reservoir")(policies.reservoir)
register("bernoulli")(policies.bernoulli)


def _of_log(run: Policy) -> Policy:
    return lambda df, capacity, key="key", **options: policies.kept(run(df, capacity, key=key, **options), key)


register("bucket_occupancy")(_of_log(policies.bucket_occupancy))
register("semantic_dedup")(_of_log(policies.semantic_dedup))
register("reservoir_r")(_of_log(policies.reservoir_r))
