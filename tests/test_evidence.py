"""The fold over histories against a plain walk, on random and hand-made ones."""

import json
import random

from pyspark.sql import functions as F

from millrace.operators import evidence as ev

STATE = f"struct<candidate_chefs:array<{ev.CHEF}>,chef_query_status:string,booking_state:struct<chef_id:string,chef_name:string,people:long>>"
CHEFS = [{"chef_id": f"c{i}", "chef_name": f"n{i}"} for i in range(6)]


def result(rng):
    some = rng.sample(CHEFS, rng.randint(1, 3))
    return rng.choice([
        {"mode": "search", "status": "matched", "candidates": some}, {"mode": "search", "status": "no_match", "candidates": []}, {"mode": "specific", "status": "available", "chef": some[0]}, {"mode": "specific", "status": "unavailable", "requested_chef": "x", "alternatives": some},
        {"mode": "search", "status": "error", "error_code": "E", "retryable": True, "message": "m"}, {"mode": "search", "status": "matched", "candidates": []}, {"mode": "search", "status": "matched"},
    ])


def sound(r):
    return not (r["status"] == "matched" and not r.get("candidates"))


def walk(messages, state):
    calls, latest, order, ids, names, offered, found, listed = {}, None, [], set(), set(), [], [], None
    for role, call, content in messages:
        if role == "assistant" and call is not None:
            calls[call] = json.loads(content)
        if role == "tool":
            r = json.loads(content) if content[:1] == "{" else None
            if not r or not sound(r):
                continue
            chefs = r.get("candidates", r.get("alternatives", [r["chef"]] if "chef" in r else []))
            if r["status"] in ("matched", "unavailable"):
                offered, listed = offered + chefs, chefs
            if r["status"] in ("matched", "unavailable", "available"):
                found = found + chefs
            if call in calls:
                latest = (r["status"], calls[call].get("chef_name"))
                order, ids, names = [c["chef_id"] for c in chefs], {c["chef_id"] for c in chefs}, {c["chef_name"] for c in chefs}
    told = list(state["candidate_chefs"])
    status = latest[0] if latest else state["chef_query_status"] if told else None
    booked = state["booking_state"]
    if booked["chef_id"] and booked["chef_name"]:
        told.append(booked)
    for c in told:
        ids.add(c["chef_id"])
        names.add(c["chef_name"])
        if not latest and c["chef_id"] not in order:
            order.append(c["chef_id"])
    may = {c["chef_id"] for c in found} | {c["chef_id"] for c in state["candidate_chefs"]} | ({booked["chef_id"]} if booked["chef_id"] else set())
    return (status, latest[1] if latest else None, sorted(ids), sorted(names), order), sorted(may), [c["chef_id"] for c in offered], listed and [c["chef_id"] for c in listed]


def test_evidence_as_by_a_walk(spark):
    rng = random.Random(9)
    cases = []
    for _ in range(200):
        messages = []
        for _ in range(rng.randint(0, 9)):
            call = rng.choice(("a", "b", "c"))
            messages.append(rng.choice([("user", None, "hi"), ("assistant", None, "text"), ("assistant", call, json.dumps({"chef_name": rng.choice((None, "x", "y")), "people": rng.randint(1, 3)})), ("tool", call, json.dumps(result(rng))), ("tool", "zz", json.dumps(result(rng))), ("tool", call, "broken")]))
        state = {"candidate_chefs": rng.sample(CHEFS, rng.choice((0, 0, 2))), "chef_query_status": "matched", "booking_state": {"chef_id": rng.choice((None, "", "c1", "c9")), "chef_name": rng.choice((None, "n1")), "people": 2}}
        cases.append((len(cases), messages, state, rng.choice((None, "c0", "c3")), rng.sample([c["chef_id"] for c in CHEFS], rng.randint(0, 3))))
    df = spark.createDataFrame(cases, f"i int, messages {ev.MESSAGES}, state {STATE}, chef string, said array<string>").withColumn("seen", ev.fold(ev.parsed(F.col("messages"))))
    got = df.select("i", ev.evidence(F.col("seen"), F.col("state")).alias("e"), ev.verified_set(F.col("seen"), F.col("state")).alias("may"), ev.provenance_issues(F.col("seen"), F.col("state"), F.col("chef"), F.col("said")).alias("issues"), ev.call_differs(ev.parsed(F.col("messages")), F.col("state.booking_state"), ("people",)).alias("call")).collect()
    for r in got:
        _, messages, state, chef, said = cases[r.i]
        want, may, offered, listed = walk(messages, state)
        assert tuple(r.e) == want and r.may == may, (messages, state, r.e, want)
        lists = {*offered, *(c["chef_id"] for c in state["candidate_chefs"])}
        moved = bool(listed) and bool(said) and said != listed and set(said) <= set(listed)
        assert r.issues == ["candidate_order"] * moved + ["unknown_chef"] * (chef is not None and bool(lists) and chef not in lists)
        calls = [json.loads(c) for role, call, c in messages if role == "assistant" and call]
        assert r.call == (["people"] if calls and calls[-1]["people"] != 2 else [])


def test_no_history_and_no_state(spark):
    df = spark.createDataFrame([(None, None), ([], None)], f"messages {ev.MESSAGES}, state {STATE}").withColumn("seen", ev.fold(ev.parsed(F.col("messages"))))
    rows = df.select(ev.evidence(F.col("seen"), F.col("state")).alias("e"), ev.verified_set(F.col("seen"), F.col("state")).alias("m")).collect()
    assert all(tuple(r.e) == (None, None, [], [], []) and r.m == [] for r in rows)


def test_histories_read_orders_once(spark):
    from millrace.plans.evidence_queries import histories

    assert histories(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 2
