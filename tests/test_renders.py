"""Renders of facts made by hand against plain dictionaries and json.dumps."""

import json

from pyspark.sql import functions as F

from millrace.operators import renders as r
from millrace.operators.decisions import SLOTS
from millrace.operators.rules import STATUS

BOOKING = "struct<chef_name:string,service_date:string,start_time:string,people:long,address:string,cuisine:string,budget_min:double,budget_max:double,menu:array<string>,ingredient_purchase:boolean,dietary_constraints:array<string>,occasion:string,chef_id:string,confirmation:boolean>"
CHEF = "struct<chef_id:string,chef_name:string>"
RESULT = f"struct<mode:string,status:string,candidates:array<{CHEF}>,alternatives:array<{CHEF}>,chef:{CHEF},requested_chef:string>"
KIND = f"id int, booking {BOOKING}, tool_mode string, tool_status string, result {RESULT}, selected {CHEF}, requested_chef string, confirms boolean, rejects boolean, scenario string"
A, B = {"chef_id": "a", "chef_name": "阿"}, {"chef_id": "b", "chef_name": 'B "x"'}
FULL = {s: None for s in SLOTS} | {"service_date": "2026-08-14", "start_time": "18:00", "people": 4, "address": "路 1\n", "budget_min": 100.5, "menu": ["鱼", "a,b: c"], "dietary_constraints": [], "chef_id": None, "confirmation": None}
OPEN = FULL | {"people": None, "address": None}


def fact(i, booking=FULL, mode="", status="", result=None, selected=None, requested=None, confirms=False, rejects=False, scenario="other"):
    return (i, booking, mode, status, {"mode": mode, "status": status} | result if result is not None else None, selected, requested, confirms, rejects, scenario)


FACTS = [
    fact(0), fact(1, OPEN), fact(2, FULL | {"people": None}), fact(3, scenario="unrelated"), fact(4, mode="search", status="matched", result={"candidates": [B, A]}), fact(5, mode="search", status="matched", result={"candidates": [B, A]}, selected=A), fact(6, mode="search", status="no_match", result={"candidates": []}),
    fact(7, mode="search", status="error", result={}), fact(8, mode="specific", status="available", result={"chef": A}), fact(9, mode="specific", status="available", result={"chef": A}, confirms=True), fact(10, mode="specific", status="unavailable", result={"requested_chef": "阿", "alternatives": [B]}, requested="阿"),
    fact(11, mode="specific", status="not_found", result={"requested_chef": "x", "alternatives": []}), fact(12, mode="search", status="odd", result={}), fact(13, rejects=True), fact(14, FULL | {"menu": None, "dietary_constraints": None}), fact(15, mode="specific", status="available", result={"chef": None, "requested_chef": ""}, selected=B),
    fact(16, FULL | {"chef_id": "old", "chef_name": "Old"}, mode="specific", status="error", result={}, confirms=None, rejects=None),
]


def expected(row):
    _, booking, mode, status, result, selected, requested, confirms, rejects, scenario = row
    known = {(m, s): (q, t) for m, s, q, t in STATUS}.get((mode, status)) if result is not None else None
    chef = (result or {}).get("chef")
    offered = [] if result is None else {"matched": result.get("candidates"), "unavailable": result.get("alternatives"), "available": [chef] if chef else []}.get(status) or []
    made = dict(booking)
    c_id = selected["chef_id"] if selected else chef["chef_id"] if status == "available" and chef else None
    c_name = selected["chef_name"] if selected else requested or (chef["chef_name"] if status == "available" and chef else None)
    made |= {k: v for k, v in (("chef_id", c_id), ("chef_name", c_name)) if v is not None}
    missing = [s for s in ("service_date", "start_time", "people", "address") if booking[s] is None]
    ask = "acknowledge_result" if not missing else f"ask_{missing[0]}" if len(missing) == 1 else "ask_multiple_required_fields"
    reply = "booking_authorized" if confirms and status == "available" else "booking_paused" if rejects else known[1] if known else "handoff" if scenario == "unrelated" else ask
    final = {
        "action": "final", "booking_state": made | {"confirmation": True if confirms else False if status == "error" or rejects else None}, "chef_query_status": known[0] if known else "not_checked", "candidate_chefs": offered, "info_complete": not missing, "unrelated": scenario == "unrelated",
        "missing_info": missing, "reply_type": reply, "reply": "",
    }
    arguments = {s: booking[s] for s in SLOTS}
    arguments |= {s: arguments[s] or [] for s in ("menu", "dietary_constraints")}
    state = {"booking_state": made, "chef_query_status": final["chef_query_status"], "candidate_chefs": offered, "awaiting_confirmation": bool(confirms or status == "available")}
    return final, arguments, state


def canonical(x):
    return json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_renders(spark):
    df = spark.createDataFrame(FACTS, KIND).select("id", r.expected_final().alias("final"), r.expected_call().alias("call"), r.arguments().alias("args"), r.current_state().alias("state"))
    got = {x.id: x for x in r.spaced_json(r.canonical_json(df, ["final", "call", "state"]), "args").collect()}
    for row in FACTS:
        final, arguments, state = expected(row)
        x = got[row[0]]
        assert x.final == canonical(final) and x.state == canonical(state), (row, x.final, canonical(final))
        assert x.call == canonical({"action": "tool_call", "tool_name": "find_chefs", "arguments": arguments})
        assert x.args == json.dumps(arguments, ensure_ascii=False)


def test_state_of_a_search(spark):
    got = {x.id: x.name for x in spark.createDataFrame(FACTS, KIND).select("id", r.query_state(F.col("result"))["chef_name"].alias("name")).collect()}
    assert {i: n for i, n in got.items() if n} == {8: "阿", 9: "阿", 10: "阿", 11: "x", 16: "Old"}


def test_prompts(spark):
    tools, contract, state = '[{"type":"function"}]', '{"a":1}', '{"b":"日"}'
    one = spark.range(1).withColumns({"past": r.history(F.lit("c1"), F.lit('say "hi"'), F.lit('{"k": "é"}'), F.lit('{"m": 1}')), "none": F.lit(None).cast("array<string>")})
    make = lambda past, said: r.prompt(F.lit(contract), F.lit('x\n"y"'), F.lit("2026-08-12 09:00"), F.lit(state), F.lit(tools), F.col(past), said)
    got = one.select(make("past", F.lit("4人")).alias("a"), make("none", F.lit(None).cast("string")).alias("b")).select("a", "b", r.with_block(F.col("a"), "\n!").alias("c"), r.to_text(F.col("a")).alias("t")).first()
    body = {"output_contract": {"a": 1}, "rules": 'x\n"y"', "current_time": "2026-08-12 09:00", "current_state": {"b": "日"}, "available_tools": [{"type": "function"}]}
    system = {"role": "system", "content": canonical(body)}
    call = {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "type": "function", "function": {"name": "find_chefs", "arguments": '{"k": "é"}'}}]}
    past = [{"role": "user", "content": 'say "hi"'}, call, {"role": "tool", "tool_call_id": "c1", "name": "find_chefs", "content": '{"m": 1}'}]
    want = [*map(canonical, [system, *past, {"role": "user", "content": "4人"}])]
    assert got.a == want and got.b == want[:1] and got.t == "\n".join(want)
    assert got.c == [canonical(system | {"content": canonical(body) + "\n!"}), *want[1:]]


def test_prompts_read_the_records_once(spark):
    from millrace.plans import render_queries as q

    assert q.prompt_messages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 2
