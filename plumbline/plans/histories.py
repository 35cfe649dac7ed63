"""Schema documents, replayed decisions, derived facts, versioned logs and table snapshots, bound to the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import histories
from ..sources import schemas, storage
from ._registry import Tables, bind

#: What an event record should look like.
EVENT = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "type": "object",
    "required": ["id", "kind", "user", "values"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 100},
        "kind": {"enum": ["view", "click", "purchase", "signup"]},
        "user": {
            "type": "object",
            "required": ["id", "name"],
            "additionalProperties": False,
            "properties": {"id": {"type": "integer", "maximum": 140}, "name": {"type": "string", "pattern": "^u[0-9]+$", "maxLength": 3}},
        },
        "props": {"$ref": "#/$defs/props"},
        "values": {
            "type": "array",
            "minItems": 2,
            "maxItems": 3,
            "uniqueItems": True,
            "items": {"anyOf": [{"type": "number", "exclusiveMinimum": 1}, {"type": "null"}]},
        },
        "amount": {"type": "number"},
    },
    "if": {"properties": {"kind": {"const": "purchase"}}, "required": ["kind"]},
    "then": {"required": ["amount"]},
    "else": {"not": {"required": ["amount"]}},
    "$defs": {"props": {"type": "object", "minProperties": 1, "properties": {"k": {"type": "integer", "maximum": 95}}}},
}


def _record(k: Column) -> Column:
    """Events as JSON text, with faults that depend on their ``k``."""
    some = lambda of, text: F.when(of, text).otherwise(F.lit(""))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    event, user, value = F.col("event_id"), F.col("user_id"), F.col("value")
    name = F.when(k % 3 == 0, F.lit('"nick": 1')).otherwise(say('"name": "u', user, '"'))
    values = say(value, ", ", k, some(k % 5 == 0, F.lit(", null")), some(k % 7 == 0, F.lit(', "x"')), some(k % 4 == 0, say(", ", value)))
    end = say(some(k % 2 == 0, say(', "amount": ', value)), some(k % 11 == 0, F.lit(', "x/y": {}')), some(k % 50 != 49, F.lit("}")))
    return say('{"id": ', event, ', "kind": "', F.col("event_type"), '", "user": {"id": ', user, ", ", name, '}, "props": ', F.col("props"), ', "values": [', values, "]", end)


@bind(
    """WITH e AS (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events),
r AS (SELECT event_id, '{"id": ' || event_id || ', "kind": "' || event_type || '", "user": {"id": ' || user_id || ', ' || CASE WHEN k % 3 = 0 THEN '"nick": 1' ELSE '"name": "u' || user_id || '"' END
  || '}, "props": ' || props || ', "values": [' || value || ', ' || k || CASE WHEN k % 5 = 0 THEN ', null' ELSE '' END || CASE WHEN k % 7 = 0 THEN ', "x"' ELSE '' END
  || CASE WHEN k % 4 = 0 THEN ', ' || value ELSE '' END || ']' || CASE WHEN k % 2 = 0 THEN ', "amount": ' || value ELSE '' END || CASE WHEN k % 11 = 0 THEN ', "x/y": {}' ELSE '' END
  || CASE WHEN k % 50 <> 49 THEN '}' ELSE '' END AS said FROM e),
j AS (SELECT event_id, said::JSON AS d FROM r WHERE json_valid(said)),
v AS (SELECT event_id, i, json_extract(d, '$.values[' || i || ']') AS x FROM j, range(json_array_length(d, '$.values')::BIGINT) t(i)),
f AS (
  SELECT event_id, '' AS path, 'json' AS keyword FROM r WHERE NOT json_valid(said)
  UNION ALL SELECT event_id, '/id', 'minimum' FROM j WHERE (d->>'$.id')::DOUBLE < 100
  UNION ALL SELECT event_id, '/kind', 'enum' FROM j WHERE (d->>'$.kind') NOT IN ('view', 'click', 'purchase', 'signup')
  UNION ALL SELECT event_id, '/user/id', 'maximum' FROM j WHERE (d->>'$.user.id')::DOUBLE > 140
  UNION ALL SELECT event_id, '/user/name', 'required' FROM j WHERE json_type(d, '$.user.name') IS NULL
  UNION ALL SELECT event_id, '/user/name', 'pattern' FROM j WHERE NOT regexp_full_match(d->>'$.user.name', 'u[0-9]+')
  UNION ALL SELECT event_id, '/user/name', 'maxLength' FROM j WHERE length(d->>'$.user.name') > 3
  UNION ALL SELECT event_id, '/user/' || key, 'additionalProperties' FROM (SELECT event_id, unnest(json_keys(d, '$.user')) AS key FROM j) WHERE key NOT IN ('id', 'name')
  UNION ALL SELECT event_id, '/' || replace(key, '/', '~1'), 'additionalProperties' FROM (SELECT event_id, unnest(json_keys(d)) AS key FROM j) WHERE key NOT IN ('id', 'kind', 'user', 'props', 'values', 'amount')
  UNION ALL SELECT event_id, '/props/k', 'maximum' FROM j WHERE (d->>'$.props.k')::DOUBLE > 95
  UNION ALL SELECT event_id, '/values', 'maxItems' FROM j WHERE json_array_length(d, '$.values') > 3
  UNION ALL SELECT event_id, '/values', 'uniqueItems' FROM (SELECT event_id, count(*) AS n, count(DISTINCT CASE WHEN json_type(x) IN ('DOUBLE', 'UBIGINT') THEN (x::DOUBLE)::VARCHAR ELSE x::VARCHAR END) AS m FROM v GROUP BY 1) WHERE m < n
  UNION ALL SELECT event_id, '/values/' || i, 'anyOf' FROM v WHERE json_type(x) = 'VARCHAR' OR (json_type(x) <> 'NULL' AND TRY_CAST(x AS DOUBLE) <= 1)
  UNION ALL SELECT event_id, '/amount', 'required' FROM j WHERE (d->>'$.kind') = 'purchase' AND json_type(d, '$.amount') IS NULL
  UNION ALL SELECT event_id, '', 'not' FROM j WHERE (d->>'$.kind') <> 'purchase' AND json_type(d, '$.amount') IS NOT NULL
)
SELECT event_id, path, keyword FROM f"""
)
def schema_issues(t: Tables) -> DataFrame:
    """Event records against a JSON Schema document."""
    # few row groups are few tasks, and the checks of a row cost much more than its way
    events = t.events.select("event_id", "user_id", "event_type", "value", "props").repartition(t.spark.sparkContext.defaultParallelism * 4)
    records = events.select("event_id", _record(F.get_json_object("props", "$.k").cast("long")).alias("record"))
    return schemas.violations(records, "record", EVENT)


def _digest(*parts: str | Column) -> Column:
    """In bytes, half as wide as in digits."""
    return F.unhex(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256))


def _proposals(t: Tables) -> DataFrame:
    digest = _digest("o_orderkey", "o_orderstatus")
    return t.orders.select(F.col("o_orderkey").alias("proposal"), digest.alias("digest"), F.substring("o_orderpriority", 1, 1).alias("snapshot"), F.col("o_custkey").alias("value"))


def _decisions(t: Tables) -> DataFrame:
    """Lines of an order as decisions on it: some were made for another state of it, some links are lost, some revisions repeat."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rank = F.row_number().over(order).cast("long")
    number = t.lineitem.withColumn("rank", rank).withColumn("id", F.col("l_orderkey") * 1000 + F.col("rank"))
    number = number.withColumn("own", _digest("id", "l_partkey")).withColumn("before", F.lag("own").over(order))
    status = F.when(F.col("l_linestatus") == "O", "O").when(F.col("l_quantity") < 25, "F").otherwise("P")
    outcome = F.when(F.col("l_returnflag") == "A", "map").when(F.col("l_returnflag") == "N", "reject").otherwise("defer")
    twice = (F.col("l_partkey") % 41 == 0) & (F.col("rank") > 1)
    return number.select(
        "id", F.col("l_orderkey").alias("proposal"), F.when(twice, F.col("rank") - 1).otherwise(F.col("rank")).alias("revision"),
        F.when(F.col("rank") > 1, F.col("id") - 1).alias("previous"), F.when(F.col("l_quantity") != 13, F.col("before")).alias("previous_digest"),
        F.col("own").alias("digest"), _digest("l_orderkey", status).alias("proposal_digest"),
        (1 + F.col("l_suppkey") % 5).cast("string").alias("snapshot"), outcome.alias("outcome"), F.col("l_partkey").alias("value"),
    )


_REPLAY = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem),
d AS (SELECT l_orderkey AS proposal, l_orderkey * 1000 + rank AS id, rank - CASE WHEN l_partkey % 41 = 0 AND rank > 1 THEN 1 ELSE 0 END AS revision, l_quantity = 13 AND rank > 1 AS lost,
  CASE WHEN l_linestatus = 'O' THEN 'O' WHEN l_quantity < 25 THEN 'F' ELSE 'P' END AS status, (1 + l_suppkey % 5)::VARCHAR AS snapshot,
  CASE l_returnflag WHEN 'A' THEN 'map' WHEN 'N' THEN 'reject' ELSE 'defer' END AS outcome, l_partkey FROM n),
g AS (SELECT *, row_number() OVER (PARTITION BY proposal ORDER BY id) AS place FROM d),
c AS (SELECT proposal, count(*) AS decisions, bool_and(revision = place AND NOT lost) AS chained, min(id) FILTER (revision = top) AS first_top
  FROM (SELECT *, max(revision) OVER (PARTITION BY proposal) AS top FROM g) GROUP BY 1),
s AS (SELECT o_orderkey AS proposal, c.first_top AS decision, coalesce(decisions, 0) AS decisions, o_custkey, d.l_partkey,
  CASE WHEN decisions IS NULL THEN 'automatic' WHEN NOT chained THEN 'broken' WHEN d.status <> o_orderstatus OR d.snapshot <> o_orderpriority[1] THEN 'stale' ELSE d.outcome END AS state
  FROM orders LEFT JOIN c ON c.proposal = o_orderkey LEFT JOIN d ON d.id = c.first_top)
"""


@bind(
    _REPLAY
    + """SELECT proposal, state, decision, decisions, decisions - CASE WHEN state IN ('automatic', 'broken', 'stale') THEN 0 ELSE 1 END AS inert,
CASE WHEN state = 'map' THEN l_partkey WHEN state IN ('automatic', 'stale') THEN o_custkey END AS effective FROM s"""
)
def decision_replay(t: Tables) -> DataFrame:
    return histories.replayed_decisions(_proposals(t), _decisions(t))


@bind(
    _REPLAY
    + """SELECT d.proposal, d.id, CASE WHEN state IN ('broken', 'stale') THEN state WHEN d.id = decision THEN 'active' ELSE 'superseded' END AS event
FROM d JOIN s ON s.proposal = d.proposal"""
)
def decision_events(t: Tables) -> DataFrame:
    decisions = _decisions(t)
    events = histories.decision_events(histories.replayed_decisions(_proposals(t), decisions), decisions)
    return events.select("proposal", "id", "event")


@bind(
    """WITH f AS (SELECT l_orderkey, l_linenumber AS n, l_orderkey * 100000 + l_partkey AS id, l_quantity AS q FROM lineitem),
w AS (SELECT l_orderkey, count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n = 3) AS n3, count(*) FILTER (n = 4) AS n4,
  min(id) FILTER (n = 1) AS i1, min(id) FILTER (n = 2) AS i2, min(id) FILTER (n = 3) AS i3, min(id) FILTER (n = 4) AS i4,
  min(q * 4) FILTER (n = 1) AS capacity, min(q % 7 / 4) FILTER (n = 2) AS share, min(12 * (1 + q % 2)) FILTER (n = 3) AS one, min(12 * (1 + q % 6)) FILTER (n = 4) AS top,
  list(q * 2) FILTER (n = 5) AS own5, list(1 + q % 4) FILTER (n = 6) AS own6 FROM f GROUP BY 1),
u AS (SELECT l_orderkey, 'usable_capacity_ah' AS target, 'Ah' AS unit, capacity * share AS value, i1 || ',' || i2 AS inputs, own5 AS own FROM w WHERE n1 = 1 AND n2 = 1 AND capacity > 0 AND share <= 1
  UNION ALL SELECT l_orderkey, 'series_count', 'count', top / one, i3 || ',' || i4, own6 FROM w WHERE n3 = 1 AND n4 = 1 AND top >= one AND top % one = 0)
SELECT l_orderkey, target, unit, value, CASE WHEN own IS NULL THEN 'mapped' WHEN len(own) = 1 AND own[1] = value THEN 'evidence_only' ELSE 'conflicting' END AS disposition,
  inputs, coalesce(len(own), 0) AS direct, list_min(own) AS least, list_max(own) AS most FROM u"""
)
def derived_facts(t: Tables) -> DataFrame:
    """Orders as products, their lines as facts: the line number says of what."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    stated = {
        "nominal_capacity_ah": q * 4, "usable_fraction": q % 7 / 4, "nominal_voltage_v": 12 * (1 + q % 2), "series_voltage_v": 12 * (1 + q % 6),
        "usable_capacity_ah": q * 2, "series_count": 1 + q % 4,
    }
    target, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for i, (name, found) in enumerate(stated.items()):
        target, value = F.when(n == i + 1, name).otherwise(target), F.when(n == i + 1, found).otherwise(value)
    facts = t.lineitem.select("l_orderkey", target.alias("name"), value.alias("stated"), (F.col("l_orderkey") * 100_000 + F.col("l_partkey")).alias("fact"))
    return histories.derived_facts(facts, histories.BATTERY, "l_orderkey", "name", "stated", "fact").withColumn("inputs", F.array_join("inputs", ","))


#: Which kind of event may follow which, for events as writes.
FOLLOWS = {
    "": ("view", "click", "purchase"),
    "view": ("view", "click", "purchase"),
    "click": ("view", "click", "purchase", "error"),
    "purchase": ("view", "click", "purchase"),
}


def event_writes(events: DataFrame) -> DataFrame:
    """Events as writes of their user: most expect the last one that is no error or signup, some an older one, signups none."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    good = F.when(~F.col("event_type").isin("error", "signup"), F.col("event_id"))
    last = F.last(good, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    older = F.last(good, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -6))
    k = F.get_json_object("props", "$.k").cast("long")
    expected = F.when(F.col("event_type") == "signup", None).when((F.col("event_type") == "error") & (k % 8 != 0), older).otherwise(last)
    return events.withColumn("expected", expected).select("user_id", "ts", "event_id", "expected", "event_type")


@bind(
    """WITH RECURSIVE g AS (SELECT *, CASE WHEN event_type NOT IN ('error', 'signup') THEN event_id END AS good FROM events),
e AS (SELECT user_id, event_id, event_type, row_number() OVER o AS n, CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' AND json_extract(props, '$.k')::BIGINT % 8 <> 0
    THEN last_value(good IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING)
    ELSE last_value(good IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS expected
  FROM g WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
w AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS current, '' AS state, 0::BIGINT AS version, '' AS outcome FROM e
  UNION ALL
  SELECT user_id, n, event_id, CASE WHEN fits AND legal THEN event_id ELSE current END, CASE WHEN fits AND legal THEN event_type ELSE state END, version + CASE WHEN fits AND legal THEN 1 ELSE 0 END,
    CASE WHEN NOT fits THEN 'conflict' WHEN legal THEN 'accepted' ELSE 'illegal' END
  FROM (SELECT e.user_id, e.n, e.event_id, e.event_type, w.current, w.state, w.version, e.expected IS NOT DISTINCT FROM w.current AS fits,
      e.event_type IN ('view', 'click', 'purchase') OR (e.event_type = 'error' AND w.state = 'click') AS legal
    FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
)
SELECT user_id, event_id, outcome, CASE WHEN outcome = 'accepted' THEN version END AS version FROM w WHERE n > 0"""
)
def versioned_writes(t: Tables) -> DataFrame:
    log = histories.versioned_log(event_writes(t.events), "user_id", ["ts", "event_id"], "event_id", "expected", "event_type", FOLLOWS)
    return log.select("user_id", "event_id", "outcome", "version")


@bind(
    """SELECT c_nationkey, count(*) AS rows, sum(('0x' || substr(sha256(to_json({'c_acctbal': c_acctbal, 'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_name': c_name, 'c_nationkey': c_nationkey})), 1, 15))::BIGINT)::VARCHAR AS snapshot
FROM customer GROUP BY 1"""
)
def table_snapshots(t: Tables) -> DataFrame:
    return storage.partition_snapshots(t.customer, ["c_nationkey"])
