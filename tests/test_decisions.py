"""Rules on decisions made by hand: each is broken once, and a sound decision breaks none."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import decisions as d
from millrace.plans import decision_queries as q

SLOTS = {"chef_name": None, "service_date": "2026-08-14", "start_time": "18:00", "people": 4, "address": "here", "cuisine": ["川菜"], "budget_min": 100, "budget_max": None, "menu": [], "ingredient_purchase": False, "dietary_constraints": ["不吃花生"], "occasion": []}
RIGHT = {
    "action": "final", "tool_name": None, "arguments": None, "booking_state": SLOTS | {"chef_id": "a", "confirmation": False}, "chef_query_status": "matched", "candidate_chefs": ["a", "b"], "info_complete": True, "unrelated": False,
    "missing_info": [], "reply_type": "present_chef_candidates", "reply": "请确认a或b，不吃花生",
}
CALL = {"action": "tool_call", "tool_name": "find_chefs", "arguments": SLOTS}
STATE = f"struct<{d._SLOT_LIST}>"
EXPECTS = "struct<asks_confirmation_for:string,asks_missing_info:array<string>,handoff:boolean,mentions_candidates:array<string>,mentions_missing_info:array<string>,mentions_no_match:boolean,mentions_out_of_service_area:boolean,mentions_requery_needed:boolean,mentions_tool_error:boolean,mentions_unavailable:string,no_success_claim:boolean,preserves_candidate_order:array<string>,preserves_dietary:array<string>,rejects_unavailable_requested_chef:boolean,rejects_unverified_selection:boolean,requires_affirmative_allowlist:boolean,uses_authorization_not_success_claim:boolean>"


def changed(of, **fields):
    out = json.loads(json.dumps(of))
    for k, v in fields.items():
        part, _, name = k.rpartition("__")
        (out[part] if part else out)[name] = v
    return out


def case(i, predicted, expected=RIGHT, expects=None, said="好的", awaiting=False, status="matched", requested=None, scenario="matched_candidates", retryable=False):
    evidence = {"latest_status": status, "requested_chef": requested, "verified_ids": ["a", "b"], "candidate_order": ["a", "b"]}
    more = {"relative": {"expression": "next_friday", "base": "2026-08-12T09:00"}, "preserved": ["dietary_constraints"], "tool": {"mode": "search", "status": status, "retryable": retryable, "ids": ["a", "b"]}}
    texts = [x if isinstance(x, str) else json.dumps(x) for x in (SLOTS, expected, predicted, evidence, expects or {}, more)]
    return (i, *texts, said, awaiting, scenario)


@pytest.fixture(scope="module")
def made(spark):
    def make(*cases):
        df = spark.createDataFrame(list(cases), "id string, state string, expected string, predicted string, evidence string, expects string, more string, user_input string, awaiting_confirmation boolean, scenario string")
        df = d.with_prediction(df.withColumnRenamed("predicted", "answer"), "answer")
        kinds = {"state": STATE, "expected": d.DECISION_TYPE, "expects": EXPECTS, "evidence": "struct<latest_status:string,requested_chef:string,verified_ids:array<string>,candidate_order:array<string>>",
                 "more": "struct<relative:struct<expression:string,base:string>,preserved:array<string>,tool:struct<mode:string,status:string,retryable:boolean,ids:array<string>>>"}
        return df.withColumns({c: F.from_json(c, k) for c, k in kinds.items()}).select("*", "more.*", F.lit(False).alias("user_confirms"))

    return make


def test_scores(made):
    near = changed(RIGHT, booking_state__cuisine=["四川菜"])
    got = {r.id: (r.a, r.b) for r in made(case("same", RIGHT), case("near", near), case("one", changed(RIGHT, unrelated=True)), case("call", CALL, CALL), case("wrong", CALL, RIGHT)).select("id", F.round(d.structured_score(), 4).alias("a"), F.round(d.task_score(), 4).alias("b")).collect()}
    assert got["same"] == got["call"] == got["near"] == (1.0, 1.0)
    assert got["one"] == (round(20 / 21, 4), round(0.7 * 20 / 21 + 0.3, 4)) and got["wrong"][0] < 0.3


def test_answers_that_are_no_decision(made):
    """Not JSON or not an object: no credit at all. Nothing said: an empty object, whose absent fields equal null ones."""
    near = changed(RIGHT, booking_state=None)
    rows = made(case("text", "sorry"), case("fence", "```json" + json.dumps(RIGHT)), case("list", json.dumps([RIGHT])), case("call", "sorry", CALL), case("empty", ""), case("null", "null"), case("part", '{"action": "final"}'), case("none", near))
    got = {r.id: (round(r.a, 4), round(r.b, 4)) for r in rows.select("id", d.structured_score().alias("a"), d.task_score().alias("b")).collect()}
    assert got["text"] == got["fence"] == got["list"] == got["call"] == got["null"] == (0.0, 0.0)
    # chef_name, budget_max, menu and occasion are null or empty in what is expected
    assert got["empty"] == (round(4 / 21, 4), round(0.7 * 4 / 21 + 0.3, 4)) and got["part"][0] == round(5 / 21, 4) and got["none"][0] == round((21 - 14 + 4) / 21, 4)
    assert {r.id: r.t for r in rows.select("id", d.critical_tags().alias("t")).collect()} == dict.fromkeys(("text", "fence", "list", "empty", "null", "part", "none"), ["dietary_constraint_loss_or_reversal"]) | {"call": []}


def test_a_call_where_an_answer_is_expected(made):
    """It has no state, so the constraints are lost; an empty set of constraints is kept by anything."""
    free = changed(RIGHT, booking_state__dietary_constraints=[])
    rows = made(case("lost", CALL), case("free", CALL, free))
    assert {r.id: r.t for r in rows.select("id", d.critical_tags().alias("t")).collect()} == {"lost": ["dietary_constraint_loss_or_reversal"], "free": []}
    passed = {(r.id, r.name): r.passed for r in d.run_assertions(rows, ["dietary_inherited", "invalidates_tool_facts"]).collect()}
    assert passed == {("lost", "dietary_inherited"): False, ("free", "dietary_inherited"): True, ("lost", "invalidates_tool_facts"): True, ("free", "invalidates_tool_facts"): True}


def test_absent_keys_are_no_change(made):
    state = {"chef_id": "a", "confirmation": True}
    rows = made(
        case("absent", RIGHT | {"booking_state": state}, awaiting=True), case("null", RIGHT | {"booking_state": state | {"people": None}}, awaiting=True), case("same", RIGHT | {"booking_state": state | {"people": 4}}, awaiting=True),
        case("call", CALL | {"reply_type": "booking_authorized", "booking_state": state}, awaiting=True), case("moved", changed(CALL, arguments__people=9) | {"reply_type": "booking_authorized", "booking_state": state}, awaiting=True),
    )
    passed = {r.id: r.passed for r in d.run_assertions(rows, ["mutation_dominates_confirmation"]).collect()}
    assert passed == {"absent": True, "null": False, "same": True, "call": True, "moved": True}
    tags = {r.id: "unauthorized_booking" in r.t for r in rows.select("id", d.critical_tags().alias("t")).collect()}
    assert tags == {"absent": False, "null": True, "same": False, "call": False, "moved": True}  # of a call its arguments count


def test_missing_fields_by_name(made):
    says = lambda text: changed(RIGHT, reply=text)
    rows = made(
        case("unknown", says("哪天 budget"), expects={"asks_missing_info": ["service_date", "budget"]}), case("unsaid", says("哪天"), expects={"asks_missing_info": ["service_date", "budget"]}), case("other", says("哪天"), expects={"mentions_missing_info": [], "asks_missing_info": ["people"]}),
        case("none", says(""), expects={"mentions_missing_info": []}), case("empty", says(""), expects={"asks_missing_info": []}),
    )
    assert {r.id: r.s for r in rows.select("id", d.reply_score().alias("s")).collect()} == {"unknown": 1.0, "unsaid": 0.0, "other": 0.0, "none": 1.0, "empty": 1.0}


def test_replies(made):
    says = lambda text: changed(RIGHT, reply=text)
    rows = made(
        case("none", says("")), case("half", says("请问哪天"), expects={"asks_missing_info": ["service_date"], "handoff": True}), case("chef", says("请确认a"), expects={"asks_confirmation_for": "a"}), case("both", says("哪天"), expects={"asks_missing_info": ["service_date", "people"]}),
        case("claim", says("预约成功"), expects={"no_success_claim": True, "uses_authorization_not_success_claim": True}), case("order", says("x"), expects={"preserves_candidate_order": ["b", "a"], "preserves_dietary": ["x"]}),
    )
    assert {r.id: r.s for r in rows.select("id", d.reply_score().alias("s")).collect()} == {"none": 1.0, "half": 0.5, "chef": 1.0, "both": 0.0, "claim": 0.0, "order": 0.5}


def test_tags_and_assertions(made):
    spoiled = {
        "chef_fabrication": case("1", changed(RIGHT, booking_state__chef_id="z", booking_state__chef_name="z")), "unavailable_to_available": case("2", changed(RIGHT, booking_state__chef_name="n"), status="unavailable", requested="n"),
        "dietary_constraint_loss_or_reversal": case("3", changed(RIGHT, reply="可以吃花生")), "unauthorized_booking": case("4", changed(RIGHT, booking_state__confirmation=True)), "claim_booking_success": case("5", changed(RIGHT, reply="预约成功")),
        "stale_chef_id": case("6", changed(RIGHT, booking_state__people=5)), "premature_find_chefs": case("7", changed(CALL, arguments__people=None), CALL), "candidate_order_semantic_mutation": case("8", changed(RIGHT, candidate_chefs=["b", "a"])),
    }
    got = {r.id: r.t for r in made(*spoiled.values(), case("0", RIGHT), case("9", changed(RIGHT, booking_state__confirmation=True), awaiting=True)).select("id", d.critical_tags().alias("t")).collect()}
    assert got["0"] == got["9"] == [] and all(got[str(i)] == [tag] for i, tag in enumerate(spoiled, 1))
    passed = {(r.id, r.name): r.passed for r in d.run_assertions(made(*spoiled.values(), case("0", RIGHT))).collect()}
    assert [n for n in d.assertions() if not passed["0", n]] == ["calls_find_chefs_after_required_slots", "invalid_json", "protocol_invalid_json"]
    assert not (passed["1", "no_fabricated_chef"] or passed["8", "candidate_order_preserved"] or passed["4", "no_unauthorized_booking"] or passed["7", "does_not_call_tool_before_required_slots"] or passed["6", "invalidates_tool_facts"] or passed["2", "unavailable_requested_chef_not_selected"])
    with pytest.raises(ValueError, match="unknown assertions: no such"):
        d.run_assertions(made(case("0", RIGHT)), ["invalid_json", "no such"])


def test_semantic_issues(made):
    rows = made(
        case("0", RIGHT), case("date", changed(RIGHT, booking_state__service_date="2026-08-15")), case("fact", changed(RIGHT, candidate_chefs=["a", "z"])), case("order", changed(RIGHT, candidate_chefs=["b", "a"])), case("diet", changed(RIGHT, booking_state__dietary_constraints=[])),
        case("confirm", RIGHT | {"reply_type": "booking_authorized"}), case("policy", RIGHT | {"reply_type": "handoff"}), case("odd", RIGHT | {"info_complete": False}), case("retry", RIGHT | {"reply_type": "acknowledge_result", "chef_query_status": "error"}, status="error", scenario="tool_error", retryable=True), case("call", CALL),
    )
    got = {r.id: r.x for r in rows.select("id", d.semantic_issues().alias("x")).collect()}
    assert got == {"0": [], "date": ["relative_time"], "fact": ["tool_fact_grounding"], "order": ["candidate_order"], "diet": ["dietary"], "confirm": ["confirmation", "reply_policy"], "policy": ["reply_policy"], "odd": ["decision_consistency"], "retry": [], "call": []}


def test_pairs(made):
    rows = d.preference_pairs(made(case("final", RIGHT), case("call", CALL, CALL), case("bare", RIGHT, RIGHT | {"candidate_chefs": [], "booking_state": RIGHT["booking_state"] | {"chef_id": None, "dietary_constraints": []}}))).collect()
    got = {k: sorted(r.heuristic for r in rows if r.id == k) for k in ("final", "call", "bare")}
    assert got == {"final": [f"H{i}" for i in range(1, 9)], "call": ["H3", "H4", "H5"], "bare": ["H1", "H2", "H3", "H5", "H6"]}
    day = {(r.id, r.heuristic): json.loads(r.rejected) for r in rows}
    assert day["final", "H5"]["booking_state"]["service_date"] == "2026-08-15" and day["final", "H8"]["candidate_chefs"] == ["b", "a"] and day["final", "H2"]["arguments"]["menu"] == []
    assert all(r.chosen != r.rejected and r.chosen_sha256 != r.rejected_sha256 and len(r.chosen_sha256) == 64 for r in rows)


def test_pairs_write_the_chosen_side_once(spark):
    from millrace.operators import decisions as d

    plan = d.preference_pairs(q.cases(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    # nothing above the rows of pairs compares with the chosen side's JSON again
    assert not [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Filter") and "rejected" in x]


def test_predictions_of_cases_are_made_once(spark):
    # a value that only predictions have: in the arguments of a call, and in the state of an answer
    plan = q.cases(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("elsewhere") <= 2


def test_targeted_pairs_make_the_cases_once(spark):
    # and carry the customer; joined to cases and orders again, every pair was shuffled
    cases = q.cases(spark, "/root/testdata/sf0.001").withColumn("targets", F.array(F.lit("H1"), F.lit("H3")))
    pairs = d.targeted_pairs(cases, F.col("id") % 5 == 0, "cust")
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 2
    assert {r.heuristic for r in pairs.select("heuristic").distinct().collect()} == {"H1", "H3", "H6"}
