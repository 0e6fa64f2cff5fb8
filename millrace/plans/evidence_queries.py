"""Queries over histories: what a customer's calls and results prove, made from all orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import booking_shapes as b
from millrace.operators import evidence as ev
from millrace.plans.rule_queries import _RECORDS
from millrace.plans.shape_sql import problems_of_text_sql
from millrace.plans.structure_queries import _RESULT_CHANGES, _RESULT_SQL, _spoilt_sql, tool_results

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def histories(spark: SparkSession, sf: str) -> DataFrame:
    """A history for each customer with orders: each order is a call, a result, or both; ids of calls repeat, and some results answer none. Every third customer brings a state."""
    k = F.col("id")
    results = tool_results(spark, sf)
    called = F.concat(F.lit("c"), (k % 3).cast("string"))
    args = F.concat(F.lit('{"chef_name":'), F.when(k % 4 == 0, "null").otherwise(F.concat(F.lit('"n'), (k % 7).cast("string"), F.lit('"'))), F.lit(',"people":'), (k % 5).cast("string"), F.lit("}"))
    message = lambda place, role, name, content: F.struct(k.alias("id"), F.lit(place).alias("place"), F.lit(role).alias("role"), name.alias("call_id"), content.alias("content"))
    calls = F.when(k % 5 != 0, F.array(message(0, "assistant", called, args))).otherwise(F.array())
    answers = F.when(k % 6 != 0, F.array(message(1, "tool", F.when(k % 11 == 0, "zz").otherwise(called), F.col("content")))).otherwise(F.array())
    told = F.array(message(2, "user", F.lit(None).cast("string"), F.lit("hi")))
    each = results.select("cust", F.concat(calls, answers, told).alias("m"), "id")
    # the orders of a customer, in the order of their keys
    whole = each.groupBy("cust").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "m"))), lambda x: x["m"])).alias("m"), F.min("id").alias("first"))
    chef = lambda n: F.struct(F.concat(F.lit("chef_"), n.cast("string")).alias("chef_id"), F.concat(F.lit("name-"), n.cast("string")).alias("chef_name"))
    state = F.struct(
        F.when(F.col("cust") % 3 == 0, F.array(chef(F.col("cust") % 13), chef(F.col("cust") % 17))).otherwise(F.array().cast(f"array<{ev.CHEF}>")).alias("candidate_chefs"), F.lit("matched").alias("chef_query_status"),
        F.struct(F.when(F.col("cust") % 5 == 0, F.concat(F.lit("chef_"), (F.col("cust") % 19).cast("string"))).alias("chef_id"), F.when(F.col("cust") % 10 == 0, "Chef").alias("chef_name"), (F.col("cust") % 5).alias("people")).alias("booking_state"),
    )
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["call_id"].alias("call_id"), x["content"].alias("content")))
    return whole.select("cust", messages.alias("messages"), state.alias("state"), F.concat(F.lit("chef_"), (F.col("cust") % 23).cast("string")).alias("chef_id"))


_HISTORY_SQL = _RECORDS + f""", res AS (SELECT id, {_RESULT_SQL}::VARCHAR AS t FROM r), rs AS (SELECT id, {_spoilt_sql('t', 'id', _RESULT_CHANGES)} AS t FROM res),
m AS (SELECT o_custkey AS cust, id * 3 AS pos, 'call' AS kind, 'c' || id % 3 AS call_id, CASE WHEN id % 4 <> 0 THEN 'n' || id % 7 END AS named, id % 5 AS people, NULL AS t FROM rs JOIN orders ON o_orderkey = id WHERE id % 5 <> 0
 UNION ALL SELECT o_custkey, id * 3 + 1, 'result', CASE WHEN id % 11 = 0 THEN 'zz' ELSE 'c' || id % 3 END, NULL, NULL, t FROM rs JOIN orders ON o_orderkey = id WHERE id % 6 <> 0 AND len({problems_of_text_sql(b.RESULT, 't')}) = 0),
p AS (SELECT *, CAST(t AS JSON) ->> '$.status' AS status, from_json(coalesce((CAST(t AS JSON) -> '$.candidates'), (CAST(t AS JSON) -> '$.alternatives'), CASE WHEN (CAST(t AS JSON) -> '$.chef') IS NOT NULL THEN json_array((CAST(t AS JSON) -> '$.chef')) END, CAST('[]' AS JSON)), '[{{"chef_id": "VARCHAR", "chef_name": "VARCHAR"}}]') AS chefs FROM m WHERE kind = 'result'),
a AS (SELECT p.cust, p.pos, p.status, p.chefs, max(c.pos) AS asked FROM p JOIN m c ON c.kind = 'call' AND c.cust = p.cust AND c.call_id = p.call_id AND c.pos < p.pos GROUP BY ALL),
hl AS (SELECT cust, max(pos) AS pos FROM a GROUP BY cust), last AS (SELECT a.cust, a.status, a.chefs, c.named AS requested FROM a JOIN hl ON hl.cust = a.cust AND hl.pos = a.pos JOIN m c ON c.cust = a.cust AND c.kind = 'call' AND c.pos = a.asked),
s AS (SELECT DISTINCT o_custkey AS cust, CASE WHEN o_custkey % 3 = 0 THEN ['chef_' || o_custkey % 13, 'chef_' || o_custkey % 17] ELSE [] END AS ids, CASE WHEN o_custkey % 3 = 0 THEN ['name-' || o_custkey % 13, 'name-' || o_custkey % 17] ELSE [] END AS names,
 CASE WHEN o_custkey % 5 = 0 THEN 'chef_' || o_custkey % 19 END AS booked, CASE WHEN o_custkey % 10 = 0 THEN 'Chef' END AS booked_name, 'chef_' || o_custkey % 23 AS said FROM orders),
own AS (SELECT *, CASE WHEN booked IS NOT NULL AND booked_name IS NOT NULL THEN [booked] ELSE [] END AS own_id, CASE WHEN booked IS NOT NULL AND booked_name IS NOT NULL THEN [booked_name] ELSE [] END AS own_name FROM s),
w AS (SELECT cust, flatten(list(list_transform(chefs, lambda x: x.chef_id)) FILTER (status IN ('matched', 'unavailable'))) AS offered, flatten(list(list_transform(chefs, lambda x: x.chef_id)) FILTER (status IN ('matched', 'unavailable', 'available'))) AS found,
 list_transform(arg_max(chefs, pos) FILTER (status IN ('matched', 'unavailable')), lambda x: x.chef_id) AS listed FROM p GROUP BY cust),
j AS (SELECT o.*, last.cust IS NOT NULL AS answered, last.status, last.requested, coalesce(list_transform(last.chefs, lambda x: x.chef_id), []) AS l_ids, coalesce(list_transform(last.chefs, lambda x: x.chef_name), []) AS l_names, coalesce(offered, []) AS offered, coalesce(found, []) AS found, listed
 FROM own o LEFT JOIN last ON last.cust = o.cust LEFT JOIN w ON w.cust = o.cust)"""


@query(_HISTORY_SQL + """, d AS (SELECT *, list_concat(ids, own_id) AS told FROM j)
SELECT cust, CASE WHEN answered THEN status WHEN len(ids) > 0 THEN 'matched' END AS latest_status, requested AS requested_chef, array_to_string(list_sort(list_distinct(list_concat(l_ids, told))), ',') AS verified_ids, array_to_string(list_sort(list_distinct(list_concat(list_concat(l_names, names), own_name))), ',') AS verified_names,
 CASE WHEN answered THEN array_to_string(l_ids, ',') ELSE array_to_string(list_filter(told, lambda x, i: NOT list_contains(told[1:i - 1], x)), ',') END AS candidate_order, array_to_string(list_sort(list_distinct(list_concat(list_concat(found, ids), CASE WHEN booked IS NOT NULL THEN [booked] ELSE [] END))), ',') AS may_authorize FROM d""")
def history_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What each customer's history proves: the last answering result and the state, and the ids an authorization may name."""
    h = histories(spark, sf).withColumn("m", ev.parsed(F.col("messages"))).withColumn("seen", ev.fold(F.col("m"))).select("cust", "state", "seen")
    e = h.withColumn("e", ev.evidence(F.col("seen"), F.col("state")))
    text = lambda c: F.array_join(c, ",").alias(c.split(".")[-1])
    return e.select("cust", "e.latest_status", "e.requested_chef", text("e.verified_ids"), text("e.verified_names"), text("e.candidate_order"), F.array_join(ev.verified_set(F.col("seen"), F.col("state")), ",").alias("may_authorize"))


@query(_HISTORY_SQL + """, c AS (SELECT cust, arg_max(people, pos) AS people FROM m WHERE kind = 'call' GROUP BY cust), x AS (SELECT j.*, c.people, list_reverse(listed) AS told_ids FROM j LEFT JOIN c ON c.cust = j.cust),
i AS (SELECT cust, unnest(list_filter([CASE WHEN len(listed) > 0 AND told_ids <> listed THEN 'candidate_order' END, CASE WHEN len(list_concat(offered, ids)) > 0 AND NOT list_contains(list_concat(offered, ids), said) THEN 'unknown_chef' END, CASE WHEN people IS NOT NULL AND people <> cust % 5 THEN 'call_people' END], lambda y: y IS NOT NULL)) AS issue FROM x)
SELECT cust, issue FROM i""")
def history_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Answers (a chef by the customer's key, the last list turned round) held against the lists of their history, and the last call against the booking."""
    h = histories(spark, sf).withColumn("m", ev.parsed(F.col("messages"))).withColumn("seen", ev.fold(F.col("m")))
    said = F.coalesce(F.reverse(F.transform("seen.listed", lambda c: c["chef_id"])), F.array().cast("array<string>"))
    calls = F.transform(ev.call_differs(F.col("m"), F.col("state.booking_state"), ("people",)), lambda s: F.concat(F.lit("call_"), s))
    return h.select("cust", F.explode(F.concat(ev.provenance_issues(F.col("seen"), F.col("state"), F.col("chef_id"), said), calls)).alias("issue"))
