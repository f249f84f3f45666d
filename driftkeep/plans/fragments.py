"""Pieces of SQL that the oracles share."""

from __future__ import annotations

from driftkeep.functions.hashing import hyperplanes

#: A vector is a query if this divides its id.
EVERY, DIM = 50, 64
TABLES, BITS = 4, 4


def h(column: str, salt: int) -> str:
    return f"('0x' || substr(md5('{salt}:' || {column}::VARCHAR), 1, 8))::BIGINT"


BASE = "e AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v, label::BIGINT AS label FROM embeddings)"
QUERIES = f"q AS (SELECT item_id AS query_id, v AS q FROM e WHERE item_id % {EVERY} = 0)"
POS = "s AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM e)"


def numbers(rows) -> str:
    return "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in r) + "]" for r in rows) + "]"


def sig_sql(tables: int, bits: int) -> str:
    """Signatures of the stream: one bucket a table, first bit most significant."""
    planes = numbers(hyperplanes(tables, bits, DIM))
    return f"""planes AS (SELECT unnest({planes}) AS w, generate_subscripts({planes}, 1) - 1 AS i),
bits AS (SELECT pos, item_id, label, v, i // {bits} AS t, (list_inner_product(v, w::DOUBLE[]) > 0)::BIGINT * (1 << ({bits - 1} - i % {bits})) AS b FROM s, planes),
buckets AS (SELECT pos, item_id, label, t, sum(b)::BIGINT AS bucket FROM bits GROUP BY ALL),
g AS (SELECT pos, item_id, label, list(bucket ORDER BY t) AS sig, row_number() OVER (PARTITION BY label ORDER BY pos) AS i FROM buckets GROUP BY pos, item_id, label)"""


SIG = sig_sql(TABLES, BITS)


def top(score: str, k: int, source: str, order: str = "DESC") -> str:
    return f"SELECT * FROM (SELECT query_id, item_id, {score} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {score} {order}, item_id) AS rank FROM {source}) WHERE rank <= {k}"


def machine(capacity: int, aggregator: str, threshold: float | None = None) -> str:
    """CTEs up to ``log``: the decisions of the bucket-occupancy policy for each label's stream."""
    if aggregator == "jaccard":
        per = f"list_transform(kept, lambda x: len(list_filter(range(1, {TABLES} + 1), lambda t: x.sig[t] = sg[t])))"
        occ = f"coalesce(list_max(list_transform({per}, lambda m: m / ({2 * TABLES} - m))), 0.0)::DOUBLE"
    else:
        name = {"mean": "avg"}.get(aggregator, aggregator)
        occ = f"list_aggregate(list_transform(range(1, {TABLES} + 1), lambda t: len(list_filter(kept, lambda x: x.sig[t] = sg[t]))), '{name}')::DOUBLE"
    accept = f"o < {threshold}" if threshold is not None else f"(len(kept) < {capacity} OR o < mx)"
    return f"""r(label, i, pos, item_id, kept, occ, accepted, evicted) AS (
  SELECT DISTINCT label, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::STRUCT(id BIGINT, oc DOUBLE, sig BIGINT[])[], 0.0::DOUBLE, false, NULL::BIGINT FROM g
  UNION ALL
  SELECT label, i, pos, item_id,
    CASE WHEN NOT ok THEN kept WHEN len(kept) < {capacity} THEN list_append(kept, me) ELSE list_append(list_filter(kept, lambda x: x.id <> victim), me) END,
    o, ok, CASE WHEN ok AND len(kept) >= {capacity} THEN victim END
  FROM (SELECT *, {accept} AS ok, {{'id': pos, 'oc': o, 'sig': sg}}::STRUCT(id BIGINT, oc DOUBLE, sig BIGINT[]) AS me,
          list_min(list_transform(list_filter(kept, lambda x: x.oc = mx), lambda x: x.id)) AS victim
        FROM (SELECT g.label, g.i, g.pos, g.item_id, g.sig AS sg, r.kept, {occ} AS o, list_max(list_transform(r.kept, lambda x: x.oc)) AS mx
              FROM r JOIN g ON g.label = r.label AND g.i = r.i + 1))
), log AS (SELECT label, i - 1 AS at, pos, item_id, accepted, occ, evicted FROM r WHERE i > 0)"""


def with_(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select
