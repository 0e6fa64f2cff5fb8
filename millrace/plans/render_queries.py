"""Queries that render training rows from the facts of scenarios, made from orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import renders
from millrace.operators.rules import STATUS
from millrace.plans.rule_queries import _RECORDS, records

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: What the prompts carry; a user gives their own.
_CONTRACT, _RULES_TEXT, _TOOLS, _BLOCK = '{"format":"exactly_one_raw_json_object"}', 'be "exact"\n日期', '[{"function":{"name":"find_chefs"},"type":"function"}]', "\nONLY JSON"


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """The facts of a scenario for each order."""
    k, c, text = F.col("id"), F.col, F.lit(None).cast("string")
    chefs = F.transform("tool_ids", lambda x: F.struct(F.concat(F.lit("chef_"), x.cast("string")).alias("chef_id"), F.concat(F.lit("厨师"), x.cast("string")).alias("chef_name")))
    none = F.array().cast(renders.CHEFS)
    status = F.when(c("status") == "odd", "error").otherwise(c("status"))
    r = records(spark, sf).withColumns({"chefs": chefs, "status": status})
    booking = {
        "chef_name": text, "service_date": c("service_date"), "start_time": c("start_time"), "people": c("people"), "address": c("address"), "cuisine": F.when(k % 3 == 1, "川菜"), "budget_min": F.when(k % 4 == 0, 100.5), "budget_max": F.lit(None).cast("double"),
        "menu": F.when(k % 2 == 0, F.array(F.lit("fish"), F.lit('"soup"'))).otherwise(F.array().cast("array<string>")), "ingredient_purchase": F.when(k % 5 != 1, k % 5 == 0), "dietary_constraints": c("diet"), "occasion": text, "chef_id": text, "confirmation": F.lit(None).cast("boolean"),
    }
    one = F.get("chefs", F.lit(0))
    result = F.struct(
        c("mode").alias("mode"), c("status").alias("status"), F.when(c("status") == "matched", c("chefs")).when(c("status") == "no_match", none).alias("candidates"), F.when(c("status") == "unavailable", c("chefs")).alias("alternatives"),
        F.when(c("status") == "available", one).alias("chef"), F.when(c("status") == "unavailable", "李师傅").alias("requested_chef"),
    )
    tool = k % 7 != 3
    return r.select(
        "id", F.struct(*[v.alias(n) for n, v in booking.items()]).alias("booking"), F.when(tool, c("mode")).otherwise("").alias("tool_mode"), F.when(tool, c("status")).otherwise("").alias("tool_status"), F.when(tool, result).alias("result"),
        F.when(k % 9 == 0, one).alias("selected"), F.when(k % 4 == 3, "王师傅").alias("requested_chef"), "confirms", "rejects", F.when(c("unrelated"), "unrelated").otherwise("other").alias("scenario"), "chefs",
    )


_CHEF_SQL = "{'chef_id': 'chef_' || x, 'chef_name': '厨师' || x}"
_KNOWN = ", ".join(f"('{m}', '{s}', '{q}', '{t}')" for m, s, q, t in STATUS)
#: Struct fields in the order of their names, as canonical JSON has them.
_BOOKING = "address: address, budget_max: CAST(NULL AS DOUBLE), budget_min: b_min, chef_id: {id}, chef_name: {name}, confirmation: {conf}, cuisine: cuisine, dietary_constraints: diet, ingredient_purchase: buys, menu: menu, occasion: NULL, people: people, service_date: service_date, start_time: start_time"
_BY_NAME = "address: address, budget_max: CAST(NULL AS DOUBLE), budget_min: b_min, chef_name: NULL, cuisine: cuisine, dietary_constraints: diet, ingredient_purchase: buys, menu: menu, occasion: NULL, people: people, service_date: service_date, start_time: start_time"
_FACTS_SQL = _RECORDS.replace("st(mode, status, query_status, tool_reply) AS", "st0(mode, status, query_status, tool_reply) AS") + f""", known(mode, status, query_status, tool_reply) AS (VALUES {_KNOWN}),
f0 AS (SELECT * REPLACE (CASE WHEN status = 'odd' THEN 'error' ELSE status END AS status), list_transform(tool_ids, lambda x: {_CHEF_SQL}) AS chefs, id % 7 <> 3 AS tool, CASE WHEN id % 3 = 1 THEN '川菜' END AS cuisine, CASE WHEN id % 4 = 0 THEN 100.5::DOUBLE END AS b_min,
 CASE WHEN id % 2 = 0 THEN ['fish', '"soup"'] ELSE [] END AS menu, CASE WHEN id % 5 <> 1 THEN id % 5 = 0 END AS buys FROM r),
f1 AS (SELECT f0.*, CASE WHEN tool THEN f0.status ELSE '' END AS ts, CASE WHEN tool THEN k.query_status END AS q, CASE WHEN tool THEN k.tool_reply END AS tr, CASE WHEN id % 9 = 0 THEN chefs[1] END AS sel FROM f0 LEFT JOIN known k ON k.mode = f0.mode AND k.status = f0.status),
f AS (SELECT *, CASE WHEN sel IS NOT NULL THEN sel.chef_id WHEN ts = 'available' THEN chefs[1].chef_id END AS c_id, CASE WHEN sel IS NOT NULL THEN sel.chef_name WHEN id % 4 = 3 THEN '王师傅' WHEN ts = 'available' THEN chefs[1].chef_name END AS c_name,
 coalesce(CASE WHEN ts IN ('matched', 'unavailable') THEN chefs WHEN ts = 'available' THEN list_slice(chefs, 1, 1) END, []) AS cand, CASE WHEN confirms THEN true WHEN ts = 'error' OR rejects THEN false END AS conf,
 CASE WHEN confirms AND ts = 'available' THEN 'booking_authorized' WHEN rejects THEN 'booking_paused' WHEN tr IS NOT NULL THEN tr WHEN unrelated THEN 'handoff' WHEN len(missing) = 0 THEN 'acknowledge_result' WHEN len(missing) = 1 THEN 'ask_' || missing[1] ELSE 'ask_multiple_required_fields' END AS reply_type FROM f1),
j AS (SELECT id, to_json({{action: 'final', booking_state: {{{_BOOKING.format(id='c_id', name='c_name', conf='conf')}}}, candidate_chefs: cand, chef_query_status: coalesce(q, 'not_checked'), info_complete: len(missing) = 0, missing_info: missing, reply: '', reply_type: reply_type, unrelated: unrelated}})::VARCHAR AS final,
 to_json({{action: 'tool_call', arguments: {{{_BY_NAME}}}, tool_name: 'find_chefs'}})::VARCHAR AS call, to_json({{awaiting_confirmation: confirms OR ts = 'available', booking_state: {{{_BOOKING.format(id='c_id', name='c_name', conf='NULL::BOOLEAN')}}}, candidate_chefs: cand, chef_query_status: coalesce(q, 'not_checked')}})::VARCHAR AS state,
 CASE WHEN tool AND mode = 'specific' THEN CASE WHEN ts = 'unavailable' THEN '李师傅' WHEN ts = 'available' THEN chefs[1].chef_name END END AS searched, tool, chefs, ts, mode, service_date, start_time, people, address, cuisine, b_min, menu, buys, diet FROM f)"""


@query(_FACTS_SQL + "SELECT id, final, call, state, searched FROM j")
def scenario_renders(spark: SparkSession, sf: str) -> DataFrame:
    """The expected answer, the call and the state of each scenario as canonical JSON, and the chef that its tool's answer shows was asked for."""
    f = facts(spark, sf).select("id", renders.expected_final().alias("final"), renders.expected_call().alias("call"), renders.current_state().alias("state"), renders.query_state(F.col("result"))["chef_name"].alias("searched"))
    return renders.canonical_json(f, ["final", "call", "state"])


def _text_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'null' ELSE CAST(to_json({c}) AS VARCHAR) END"


def _list_sql(c: str) -> str:
    return f"'[' || array_to_string(list_transform({c}, lambda x: CAST(to_json(x) AS VARCHAR)), ', ') || ']'"


_ARGS_TEXT = " || ', ' || ".join(
    f"'\"{n}\": ' || {v}"
    for n, v in {
        "chef_name": "'null'", "service_date": _text_sql("service_date"), "start_time": _text_sql("start_time"), "people": _text_sql("people"), "address": _text_sql("address"), "cuisine": _text_sql("cuisine"), "budget_min": _text_sql("b_min"), "budget_max": "'null'",
        "menu": _list_sql("menu"), "ingredient_purchase": _text_sql("buys"), "dietary_constraints": _list_sql("diet"), "occasion": "'null'",
    }.items()
)
_CHEFS_TEXT = "'[' || array_to_string(list_transform({c}, lambda x: '{{\"chef_id\": ' || to_json(x.chef_id) || ', \"chef_name\": ' || to_json(x.chef_name) || '}}'), ', ') || ']'"


@query(_FACTS_SQL + f""", a AS (SELECT *, '{{' || {_ARGS_TEXT} || '}}' AS args, '{{"mode": "' || mode || '", "status": "' || ts || '", "chefs": ' || {_CHEFS_TEXT.format(c='chefs')} || '}}' AS result, 'call_' || id AS call_id FROM j),
b AS (SELECT id, to_json({{content: '{{"available_tools":' || '{_TOOLS}' || ',"current_state":' || state || ',"current_time":"2026-08-12 09:00","output_contract":' || '{_CONTRACT}' || ',"rules":' || to_json('{_RULES_TEXT}') || '}}' || '{_BLOCK}', role: 'system'}})::VARCHAR AS s,
 CASE WHEN tool THEN chr(10) || to_json({{content: '你好', role: 'user'}}) || chr(10) || to_json({{content: NULL, role: 'assistant', tool_calls: [{{'function': {{arguments: args, name: 'find_chefs'}}, id: call_id, type: 'function'}}]}}) || chr(10) || to_json({{content: result, name: 'find_chefs', role: 'tool', tool_call_id: call_id}}) ELSE '' END AS h,
 CASE WHEN id % 5 <> 2 THEN chr(10) || to_json({{content: '4"人', role: 'user'}}) ELSE '' END AS u FROM a)
SELECT id, CAST(length(s || h || u) AS BIGINT) AS n_chars, sha256(s || h || u) AS prompt_sha256 FROM b""")
def prompt_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The whole prompt of each scenario, a line of canonical JSON for each message: system with an added block, history with call and answer, user."""
    f = facts(spark, sf).select(
        "id", renders.current_state().alias("state"), renders.arguments().alias("args"), F.when(F.col("tool_mode") != "", F.concat(F.lit("call_"), F.col("id").cast("string"))).alias("call_id"),
        F.struct(F.col("tool_mode").alias("mode"), F.col("tool_status").alias("status"), F.col("chefs").alias("chefs")).alias("answer"),
    )
    f = renders.spaced_json(renders.spaced_json(renders.canonical_json(f, ["state"]), "args"), "answer")
    past = F.when(F.col("call_id").isNotNull(), renders.history(F.col("call_id"), F.lit("你好"), F.col("args"), F.col("answer")))
    messages = renders.prompt(F.lit(_CONTRACT), F.lit(_RULES_TEXT), F.lit("2026-08-12 09:00"), F.col("state"), F.lit(_TOOLS), past, F.when(F.col("id") % 5 != 2, '4"人'))
    text = renders.to_text(renders.with_block(messages, _BLOCK))
    return f.select("id", text.alias("text")).select("id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("prompt_sha256"))
