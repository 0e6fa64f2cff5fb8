"""Queries that score, assert, flag and perturb whole booking decisions, nested as the rules expect them.

The test tables hold no such decisions, so ``cases`` makes one from each order and its lines; predictions differ from what is expected in every field, by rules on the order's key.
A prediction is written as JSON, some without their null fields and some not as an object, and read back, as a model's answer would be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import decisions as d
from millrace.operators.rules import missing_slots, with_tool_status
from millrace.operators.shapes import let
from millrace.plans.rule_queries import _RECORDS, records

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_EXPECTATIONS = (
    "asks_confirmation_for", "asks_missing_info", "handoff", "mentions_candidates", "mentions_missing_info", "mentions_no_match", "mentions_out_of_service_area", "mentions_requery_needed", "mentions_tool_error",
    "mentions_unavailable", "no_success_claim", "preserves_candidate_order", "preserves_dietary", "rejects_unavailable_requested_chef", "rejects_unverified_selection", "requires_affirmative_allowlist", "uses_authorization_not_success_claim",
)
_SCENARIOS = (*d.REPLY_POLICY, "other")
_SAID = ("确认", "可以", "我想换一个", "好的", "确认一下时间")
_REPLIES = ("预约成功", "没有匹配的厨师", "不在服务范围", "暂时不可用，请稍后再试", "需要重新查询", "转人工", "已验证的候选如下", "约不了，可选替代", "请问日期和几点，人数和地址", "请确认是否预约chef", "可以吃vegan", "", "好的，no peanuts和vegan")


def cases(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("id"), lambda c: F.col(c)
    none, text = F.array().cast("array<string>"), lambda x: F.lit(x).cast("string")
    chef = lambda c: F.concat(F.lit("chef_"), c.cast("string"))
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    r = with_tool_status(records(spark, sf)).withColumn("missing", missing_slots())
    r = r.withColumns({"order_ids": F.transform("tool_ids", chef), "told_ids": F.transform("said_ids", chef), "name": F.when(F.col("mode") == "specific", F.concat(F.lit("name-"), F.col("chef_id").cast("string"))), "call": k % 4 == 1})
    state = {
        "chef_name": s("name"), "service_date": s("service_date"), "start_time": s("start_time"), "people": s("people"), "address": s("address"), "cuisine": F.when(k % 5 < 2, F.array(F.lit("川菜"))).otherwise(none),
        "budget_min": (k % 7 * 100).cast("long"), "budget_max": F.when(k % 3 == 0, (k % 7 * 100 + 1000).cast("long")), "menu": F.when(k % 6 == 0, F.array(F.lit("鱼"), F.lit("汤"))).otherwise(none),
        "ingredient_purchase": k % 8 == 0, "dietary_constraints": s("diet"), "occasion": F.when(k % 10 == 0, F.array(F.lit("生日"))).otherwise(none),
    }
    expected = state | {"people": F.when(k % 12 == 0, F.col("people") + 1).otherwise(F.col("people"))}
    predicted = expected | {
        "start_time": F.when(k % 33 == 0, F.lit("00:00")).otherwise(s("start_time")), "people": F.when(k % 35 == 0, F.lit(20)).otherwise(expected["people"]), "address": F.when(k % 38 == 0, F.lit("elsewhere")).otherwise(s("address")), "budget_min": F.when(k % 39 != 0, state["budget_min"]),
        "ingredient_purchase": F.when(k % 45 == 0, F.lit(True)).otherwise(state["ingredient_purchase"]),
        "chef_name": F.when(k % 37 == 0, F.lit("name-x")).otherwise(s("name")), "service_date": F.when(k % 14 == 0, F.lit("2026-01-01")).otherwise(s("service_date")), "cuisine": F.when(k % 10 == 1, F.array(F.lit("四川菜"))).otherwise(state["cuisine"]),
        "budget_max": F.when(k % 15 != 0, state["budget_max"]), "menu": F.when(k % 9 == 0, none).otherwise(state["menu"]), "dietary_constraints": s("said_diet"), "occasion": F.when(k % 20 == 0, F.array(F.lit("生日宴"))).otherwise(state["occasion"]),
    }
    struct = lambda of: F.struct(*[v.alias(n) for n, v in of.items()])

    def decision(of: dict, call, chef_id, confirmation, status, candidates, complete, unrelated, missing, reply_type, reply):
        final = {
            "chef_query_status": status, "candidate_chefs": candidates, "info_complete": complete, "unrelated": unrelated, "missing_info": missing, "reply_type": reply_type, "reply": reply,
        }
        return struct({
            "action": F.when(call, "tool_call").otherwise("final"), "tool_name": F.when(call, F.lit("find_chefs")), "arguments": F.when(call, struct(of)), "booking_state": F.when(~call, struct(of | {"chef_id": chef_id, "confirmation": confirmation})),
        } | {n: F.when(~call, v) for n, v in final.items()}).cast(d.DECISION_TYPE)

    reply_type = F.when(k % 13 == 0, "booking_authorized").when(F.col("unrelated"), "handoff").otherwise("acknowledge_result")
    right = decision(expected, s("call"), chef(F.get("tool_ids", F.lit(0))), k % 13 == 0, s("query_status"), s("order_ids"), F.size("missing") == 0, s("unrelated"), s("missing"), reply_type, text("好的"))
    told = decision(predicted, F.when((k % 16 == 5) | (k % 12 == 2), ~s("call")).otherwise(s("call")), F.when(k % 29 == 0, F.lit("chef_x")).when(k % 31 != 0, chef(F.get("tool_ids", F.lit(0)))), k % 26 == 0, F.when(k % 11 == 0, "not_checked").otherwise(s("query_status")),
                    F.when(k % 21 == 0, none).otherwise(s("told_ids")), (F.size("missing") == 0) != (k % 47 == 0), F.when(k % 46 == 0, ~s("unrelated")).otherwise(s("unrelated")), F.when(k % 18 == 0, none).otherwise(s("missing")), F.when(k % 51 == 0, "handoff").otherwise(reply_type), pick(_REPLIES, k))
    # the prediction is made once and then written, not once for each way of writing and spoiling it
    written = let(told, lambda t: F.when(k % 3 == 0, F.to_json(t)).otherwise(F.to_json(t, {"ignoreNullFields": "false"})))
    raw = let(written, lambda t: F.when(k % 41 == 7, F.concat(F.lit("```json"), t)).when(k % 43 == 9, F.concat(F.lit("["), t, F.lit("]"))).when(k % 53 != 0, t))
    asked = lambda n: (k % 17 == n) | (F.floor(k / 17) % 17 == n)
    values = {"asks_confirmation_for": F.lit("chef"), "asks_missing_info": s("missing"), "mentions_missing_info": s("missing"), "mentions_candidates": F.array(F.lit("候选")), "mentions_unavailable": F.lit("替代"), "preserves_candidate_order": s("told_ids"), "preserves_dietary": s("diet")}
    expects = F.struct(*[F.when(asked(n), values.get(e, F.lit(True))).alias(e) for n, e in enumerate(_EXPECTATIONS)])
    evidence = F.struct(s("query_status").alias("latest_status"), F.when(k % 7 != 0, s("name")).alias("requested_chef"), s("order_ids").alias("verified_ids"), s("order_ids").alias("candidate_order"))
    made = r.select(
        "id", "cust", F.concat(F.lit("case_"), k.cast("string")).alias("case_id"), struct(state).alias("state"), right.alias("expected"), raw.alias("answer"), evidence.alias("evidence"), expects.alias("expects"),
        pick(_SAID, k).alias("user_input"), (k % 3 != 1).alias("awaiting_confirmation"), pick(_SCENARIOS, k).alias("scenario"), s("confirms").alias("user_confirms"),
        F.struct(F.when(k % 3 == 0, "today").when(k % 9 == 2, "next_monday").when(k % 21 == 5, "tomorrow").alias("expression"), F.concat("service_date", F.lit("T10:00")).alias("base")).alias("relative"),
        F.when(k % 2 == 0, F.array(F.lit("dietary_constraints"))).otherwise(none).alias("preserved"), F.struct("mode", "status", (k % 25 < 9).alias("retryable"), s("order_ids").alias("ids")).alias("tool"),
    )
    return d.with_prediction(made, "answer")


def _sql_pick(values: tuple[str, ...]) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[CAST(id % {len(values)} + 1 AS INT)]"


#: Slots of the cases in SQL: what holds before, and what is predicted (None: as before).
_SLOTS = {
    "name": ("name", "CASE WHEN id % 37 = 0 THEN 'name-x' ELSE name END"), "date": ("service_date", "CASE WHEN id % 14 = 0 THEN '2026-01-01' ELSE service_date END"), "time": ("start_time", "CASE WHEN id % 33 = 0 THEN '00:00' ELSE start_time END"),
    "people": ("people", "CASE WHEN id % 35 = 0 THEN 20 ELSE e_people END"), "address": ("address", "CASE WHEN id % 38 = 0 THEN 'elsewhere' ELSE address END"), "cuisine": ("cuisine", "CASE WHEN id % 10 = 1 THEN ['四川菜'] ELSE cuisine END"),
    "min": ("b_min", "CASE WHEN id % 39 <> 0 THEN b_min END"), "max": ("b_max", "CASE WHEN id % 15 <> 0 THEN b_max END"), "menu": ("menu", "CASE WHEN id % 9 = 0 THEN [] ELSE menu END"), "buys": ("buys", "CASE WHEN id % 45 = 0 THEN true ELSE buys END"),
    "diet": ("diet", "said_diet"), "occ": ("occ", "CASE WHEN id % 20 = 0 THEN ['生日宴'] ELSE occ END"),
}
_BY_MEANING = ("cuisine", "menu", "diet", "occ")
#: Fields of a predicted answer, null in a call and where there is no prediction; some answers have lost their null fields (bare).
_ANSWER = {
    "chef": "CASE WHEN id % 29 = 0 THEN 'chef_x' WHEN id % 31 <> 0 THEN e_chef END", "conf": "id % 26 = 0", "type": "CASE WHEN id % 51 = 0 THEN 'handoff' ELSE reply_type END", "status": "CASE WHEN id % 11 = 0 THEN 'not_checked' ELSE latest END",
    "cand": "CASE WHEN id % 21 = 0 THEN [] ELSE told_ids END", "unrelated": "CASE WHEN id % 46 = 0 THEN NOT unrelated ELSE unrelated END", "missing": "CASE WHEN id % 18 = 0 THEN [] ELSE missing END", "complete": "(len(missing) = 0) <> (id % 47 = 0)", "said": "reply",
}
_CASES = _RECORDS + f""", c0 AS (SELECT r.*, query_status, coalesce(query_status, 'not_checked') AS latest, list_transform(tool_ids, lambda x: 'chef_' || x) AS order_ids, list_transform(said_ids, lambda x: 'chef_' || x) AS told_ids,
 CASE WHEN mode = 'specific' THEN 'name-' || chef_id END AS name, id % 4 = 1 AS call, id % 53 = 0 AS empty, id % 53 <> 0 AND false AS no, id % 41 = 7 OR id % 43 = 9 AS bad, id % 3 = 0 AS bare FROM r LEFT JOIN st USING (mode, status)),
c1 AS (SELECT *, NOT bad AND NOT empty AND CASE WHEN id % 16 = 5 OR id % 12 = 2 THEN NOT call ELSE call END AS p_call, NOT bad AND NOT empty AND CASE WHEN id % 16 = 5 OR id % 12 = 2 THEN call ELSE NOT call END AS p_final,
 CASE WHEN id % 7 <> 0 THEN name END AS requested, {_sql_pick(_SAID)} AS said, id % 3 <> 1 AS awaiting, CASE WHEN id % 12 = 0 THEN people + 1 ELSE people END AS e_people, CASE WHEN id % 5 < 2 THEN ['川菜'] ELSE [] END AS cuisine, id % 7 * 100 AS b_min,
 CASE WHEN id % 3 = 0 THEN id % 7 * 100 + 1000 END AS b_max, CASE WHEN id % 6 = 0 THEN ['鱼', '汤'] ELSE [] END AS menu, id % 8 = 0 AS buys, CASE WHEN id % 10 = 0 THEN ['生日'] ELSE [] END AS occ, 'chef_' || tool_ids[1] AS e_chef,
 CASE WHEN id % 13 = 0 THEN 'booking_authorized' WHEN unrelated THEN 'handoff' ELSE 'acknowledge_result' END AS reply_type, {_sql_pick(_REPLIES)} AS reply FROM c0),
c AS (SELECT *, {', '.join(f"CASE WHEN p_call OR p_final THEN {p} END AS p_{n}" for n, (_, p) in _SLOTS.items())}, {', '.join(f"CASE WHEN p_final THEN {x} END AS p_{n}" for n, x in _ANSWER.items())}, coalesce(CASE WHEN p_final THEN reply END, '') AS p_reply FROM c1)
""".replace(", id % 53 <> 0 AND false AS no", "")


def _any(column: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


_ASKED = {e: f"(id % 17 = {n} OR id // 17 % 17 = {n})" for n, e in enumerate(_EXPECTATIONS)}
_FIELDS = " AND ".join(f"(NOT list_contains(missing, '{k}') OR {_any('p_reply', v)})" for k, v in d.FIELD_PHRASES.items())
_CHECKS = {
    f"(({_ASKED['mentions_missing_info']} AND len(missing) > 0) OR {_ASKED['asks_missing_info']})": _FIELDS,
    _ASKED["asks_confirmation_for"]: f"contains(p_reply, 'chef') AND {_any('p_reply', d.CONFIRMATION)}",
    _ASKED["mentions_candidates"]: "contains(p_reply, '候选')",
    _ASKED["mentions_unavailable"]: f"contains(p_reply, '替代') AND {_any('p_reply', d.UNAVAILABLE)}",
    _ASKED["mentions_no_match"]: "contains(p_reply, '没有匹配') OR (contains(p_reply, '没有') AND contains(p_reply, '厨师'))",
    _ASKED["mentions_out_of_service_area"]: _any("p_reply", ("服务范围", "不在服务")),
    _ASKED["mentions_tool_error"]: _any("p_reply", ("暂时不可用", "稍后再试")) + " OR (contains(p_reply, '查询') AND contains(p_reply, '不可用'))",
    _ASKED["mentions_requery_needed"]: _any("p_reply", d.REQUERY),
    _ASKED["handoff"]: _any("p_reply", d.HANDOFF),
    _ASKED["rejects_unverified_selection"]: _any("p_reply", ("已验证", "候选")),
    _ASKED["rejects_unavailable_requested_chef"]: _any("p_reply", d.UNAVAILABLE) + " AND " + _any("p_reply", ("替代", "候选")),
    _ASKED["requires_affirmative_allowlist"]: _any("p_reply", d.CONFIRMATION),
    f"({_ASKED['no_success_claim']} OR {_ASKED['uses_authorization_not_success_claim']})": "NOT " + _any("p_reply", d.SUCCESS_IN_REPLY),
    _ASKED["preserves_dietary"]: "len(list_filter(diet, lambda x: NOT contains(p_reply, x))) = 0",
    _ASKED["preserves_candidate_order"]: "told_ids = order_ids",
}
_MET = " + ".join(f"CAST({on} AND ({ok}) AS INT)" for on, ok in _CHECKS.items())
_OF = " + ".join(f"CAST({on} AS INT)" for on in _CHECKS)


@query(_CASES + f"SELECT id, CAST({_OF} AS INT) AS n_expected, CAST({_MET} AS INT) AS n_met, round(CASE WHEN {_OF} = 0 THEN 1 ELSE ({_MET}) / ({_OF}) END, 6) AS score FROM c")
def reply_expectations(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the expectations a reply meets."""
    checks = list(d.reply_checks().values())
    return cases(spark, sf).select("id", sum(c.isNotNull().cast("int") for c in checks).alias("n_expected"), sum(F.coalesce(c, F.lit(False)).cast("int") for c in checks).alias("n_met"), F.round(d.reply_score(), 6).alias("score"))


def _meaning(e: str, p: str) -> str:
    """F1 of values of which at most one is similar to another."""
    known = " OR ".join(f"(list_contains({a}, '{x}') AND list_contains({b}, '{y}'))" for x, y in (("川菜", "四川菜"), ("生日", "生日宴")) for a, b in ((e, p), (p, e)))
    return f"(CASE WHEN len({e}) + len({p}) = 0 THEN 1.0 ELSE 2.0 * (len(list_intersect({e}, {p})) + CAST(len(list_intersect({e}, {p})) = 0 AND ({known}) AS INT)) / (len({e}) + len({p})) END)"


def _same(e: str, p: str) -> str:
    return f"CAST({e} IS NOT DISTINCT FROM {p} AS INT)"


def _slot(n: str, e: str, p: str) -> str:
    return _meaning(e, p) if n in _BY_MEANING else _same(e, p)


_EXPECTED = {n: "e_people" if n == "people" else e for n, (e, _) in _SLOTS.items()}
_SLOT_SQL = " + ".join(_slot(n, e, f"p_{n}") for n, e in _EXPECTED.items())
_NO_SLOTS = " + ".join(_slot(n, e, "[]" if n in _BY_MEANING else "NULL") for n, e in _EXPECTED.items())
_RIGHT = {"e_chef": "p_chef", "id % 13 = 0": "p_conf", "latest": "p_status", "order_ids": "p_cand", "len(missing) = 0": "p_complete", "unrelated": "p_unrelated", "missing": "p_missing", "reply_type": "p_type"}
_FINAL = " + ".join(_same(e, p) for e, p in _RIGHT.items())
_NO_FINAL = " + ".join(_same(e, "NULL") for e in _RIGHT)
_STRUCTURED = f"""CASE WHEN bad THEN 0 WHEN call AND p_call THEN (2 + {_SLOT_SQL}) / 14 WHEN call THEN ({_NO_SLOTS}) / 14 WHEN p_final THEN (1 + {_SLOT_SQL} + {_FINAL}) / 21 ELSE ({_NO_SLOTS} + {_NO_FINAL}) / 21 END"""


@query(_CASES + f"""SELECT id, CASE WHEN call THEN 14 ELSE 21 END AS n_checks, round({_STRUCTURED}, 6) AS structured, round(0.7 * ({_STRUCTURED}) + 0.3 * CASE WHEN bad THEN 0 WHEN call OR {_OF} = 0 THEN 1 ELSE ({_MET}) / ({_OF}) END, 6) AS score FROM c""")
def decision_scores(spark: SparkSession, sf: str) -> DataFrame:
    """All 14 checks of a tool call or 21 of a final answer, and the score with the reply."""
    n = F.when(F.col("expected.action") == "tool_call", len(d.tool_checks())).otherwise(len(d.final_checks()))
    return cases(spark, sf).select("id", n.alias("n_checks"), F.round(d.structured_score(), 6).alias("structured"), F.round(d.task_score(), 6).alias("score"))


_SAYS = "(said IN ('确认', '可以', '好的', '就这样', '确认预约'))"
#: A slot that the prediction gives (a bare answer gives no null) is other than before.
_OTHER = "(" + " OR ".join(f"((NOT bare OR p_{n} IS NOT NULL) AND p_{n} IS DISTINCT FROM {e})" for n, (e, _) in _SLOTS.items()) + ")"
_MOVED, _DIFFERS = f"(p_final AND {_OTHER})", f"((p_final OR p_call) AND {_OTHER})"
_VERIFIED = "coalesce(list_contains(order_ids, p_chef), false)"
_CLAIMS = "(coalesce(p_conf, false) OR coalesce(p_type = 'booking_authorized', false))"
_ALLOWED = f"(awaiting AND {_SAYS} AND {_VERIFIED})"
_COMPLETE = "(p_call AND p_date IS NOT NULL AND p_time IS NOT NULL AND p_people IS NOT NULL AND p_address IS NOT NULL)"
_KEPT_DIET = "(call OR list_has_all(CASE WHEN p_final THEN p_diet ELSE [] END, diet))"
_BROKEN = "(coalesce(len(p_cand), 0) > 0 AND p_cand <> order_ids)"
_ASSERTS = {
    "asks_missing_info": "call OR list_has_all(coalesce(p_missing, []), missing)",
    "authorized_only_with_allowlist": f"NOT {_CLAIMS} OR {_ALLOWED}",
    "calls_find_chefs_after_required_slots": _COMPLETE,
    "tool_fact_grounded": f"p_chef IS NULL OR {_VERIFIED}",
    "candidate_order_preserved": f"NOT {_BROKEN}",
    "dietary_inherited": _KEPT_DIET,
    "does_not_call_tool": "NOT p_call",
    "does_not_call_tool_before_required_slots": f"NOT p_call OR {_COMPLETE}",
    "invalidates_tool_facts": f"NOT {_MOVED} OR (p_chef IS NULL AND coalesce(len(p_cand), 0) = 0)",
    "mutation_dominates_confirmation": f"NOT (({_SAYS} OR contains(said, '确认')) AND {_MOVED} AND coalesce(p_conf, false))",
    "no_booking_success_claim": f"NOT {_any('p_reply', d.SUCCESS_IN_REPLY)}",
    "no_fabricated_chef": f"p_chef IS NULL OR {_VERIFIED}",
    "no_tool_retry": "NOT p_call",
    "no_unauthorized_booking": f"NOT {_CLAIMS} OR {_ALLOWED}",
    "invalid_json": "false",
    "protocol_invalid_json": "false",
    "unavailable_requested_chef_not_selected": "NOT (latest = 'unavailable' AND requested IS NOT NULL AND p_final AND p_name IS NOT DISTINCT FROM requested)",
    "unrelated_handoff": "coalesce(p_unrelated, false) = coalesce(p_type = 'handoff', false)",
}


@query(_CASES + ", a AS (SELECT unnest([" + ", ".join(f"{{'name': '{n}', 'ok': {ok}}}" for n, ok in _ASSERTS.items()) + "], recursive := true) FROM c) SELECT name, count(*) AS n, count(*) FILTER (ok) AS n_passed FROM a GROUP BY name")
def assertion_results(spark: SparkSession, sf: str) -> DataFrame:
    """Cases that pass each of the 18 named assertions."""
    a = d.run_assertions(cases(spark, sf).withColumn("id", F.col("case_id")))
    return a.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"))


_STALE = "(" + " OR ".join(f"(p_{n} IS NOT NULL AND p_{n} IS DISTINCT FROM {e})" for n, (e, _) in _SLOTS.items() if n != "name") + ")"
_TAGS = {
    "chef_fabrication": f"p_chef IS NOT NULL AND NOT {_VERIFIED} AND p_name IS DISTINCT FROM requested",
    "unavailable_to_available": "p_chef IS NOT NULL AND latest = 'unavailable' AND requested IS NOT NULL AND p_name IS NOT DISTINCT FROM requested",
    "dietary_constraint_loss_or_reversal": f"NOT call AND (NOT {_KEPT_DIET} OR ((contains(p_reply, '可以吃') OR contains(p_reply, '能吃')) AND len(list_filter(diet, lambda x: contains(p_reply, replace(x, '不吃', '')))) > 0))",
    "unauthorized_booking": f"{_CLAIMS} AND NOT ({_ALLOWED} AND NOT {_DIFFERS})",
    "claim_booking_success": _any("p_reply", d.SUCCESS_CLAIMS),
    "stale_chef_id": f"p_chef IS NOT NULL AND {_STALE}",
    "premature_find_chefs": f"p_call AND NOT {_COMPLETE}",
    "candidate_order_semantic_mutation": _BROKEN,
}


@query(_CASES + "SELECT id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {ok} THEN '{n}' END" for n, ok in _TAGS.items()) + "], lambda x: x IS NOT NULL)), ',') AS tags FROM c")
def critical_tags(spark: SparkSession, sf: str) -> DataFrame:
    """All eight critical errors of each case."""
    return cases(spark, sf).select("id", F.array_join(d.critical_tags(), ",").alias("tags"))


_POLICY = " OR ".join(f"(scenario = '{k}' AND p_type IN ({', '.join(repr(x) for x in v)}))" for k, v in d.REPLY_POLICY.items())
_DUE = "CASE WHEN id % 3 = 0 THEN CAST(service_date AS DATE) WHEN id % 9 = 2 THEN CAST(service_date AS DATE) + CAST(8 - isodow(CAST(service_date AS DATE)) AS INT) WHEN id % 21 = 5 THEN CAST(service_date AS DATE) + 1 END"
_OUR_MISSING = "list_filter([CASE WHEN p_date IS NULL THEN 'service_date' END, CASE WHEN p_time IS NULL THEN 'start_time' END, CASE WHEN p_people IS NULL THEN 'people' END, CASE WHEN p_address IS NULL THEN 'address' END], lambda x: x IS NOT NULL)"
_SEMANTIC = {
    "relative_time": f"p_date <> strftime({_DUE}, '%Y-%m-%d')",
    "tool_fact_grounding": "p_final AND ((p_chef IS NOT NULL AND NOT list_contains(order_ids, p_chef)) OR NOT list_has_all(order_ids, p_cand))",
    "candidate_order": "p_final AND list_filter(p_cand, lambda x: list_contains(order_ids, x)) <> list_filter(order_ids, lambda x: list_contains(p_cand, x))",
    "dietary": "id % 2 = 0 AND p_diet IS DISTINCT FROM diet",
    "confirmation": "p_final AND ((scenario = 'explicit_confirmation' AND NOT p_conf) OR (p_type = 'booking_authorized' AND scenario <> 'explicit_confirmation' AND NOT confirms))",
    "reply_policy": f"p_final AND scenario <> 'other' AND NOT ({_POLICY} OR (scenario = 'tool_error' AND id % 25 < 9 AND p_type = 'acknowledge_result'))",
    "decision_consistency": f"p_final AND ({_OUR_MISSING} <> p_missing OR p_complete <> (len({_OUR_MISSING}) = 0) OR (p_status = 'matched' AND len(p_cand) = 0) OR (p_status = 'no_match' AND len(p_cand) > 0) OR (query_status IS NOT NULL AND query_status <> p_status))",
}


@query(_CASES + f", x AS (SELECT *, {_sql_pick(_SCENARIOS)} AS scenario FROM c) SELECT id, unnest(list_filter([" + ", ".join(f"CASE WHEN {ok} THEN '{n}' END" for n, ok in _SEMANTIC.items()) + "], lambda x: x IS NOT NULL)) AS issue FROM x")
def semantic_issue_report(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each semantic rule that a decision breaks."""
    return cases(spark, sf).select("id", F.explode(d.semantic_issues()).alias("issue"))


_PAIRS = {
    "H1": "NOT call", "H2": "NOT call", "H3": "true", "H4": "len(diet) > 0", "H5": "true", "H6": "NOT call AND NOT (id % 13 = 0)", "H7": "NOT call AND (len(order_ids) > 0 OR e_chef IS NOT NULL)", "H8": "NOT call AND list_reverse(order_ids) <> order_ids",
}
_NEXT = "coalesce(strftime(CAST(service_date AS DATE) + 1, '%Y-%m-%d'), '2026-01-01')"


@query(_CASES + ", p AS (" + " UNION ALL ".join(f"SELECT *, '{h}' AS heuristic FROM c WHERE {on}" for h, on in _PAIRS.items()) + f""")
SELECT id, heuristic, CASE WHEN heuristic = 'H2' OR call THEN 'tool_call' ELSE 'final' END AS action, CASE WHEN heuristic = 'H2' THEN NULL WHEN heuristic = 'H3' THEN '2026-01-01' WHEN heuristic = 'H5' THEN {_NEXT} ELSE service_date END AS service_date,
 CASE WHEN call OR heuristic = 'H2' THEN NULL WHEN heuristic = 'H1' THEN 'chef_fake_999' WHEN heuristic = 'H3' THEN 'chef_stale_001' WHEN heuristic = 'H7' AND len(order_ids) = 0 THEN 'chef_outside_777' ELSE e_chef END AS chef_id,
 CASE WHEN call OR heuristic = 'H2' OR len(order_ids) = 0 THEN NULL WHEN heuristic = 'H7' THEN 'chef_outside_777' WHEN heuristic = 'H8' THEN order_ids[len(order_ids)] ELSE order_ids[1] END AS first_candidate,
 CASE WHEN call OR heuristic = 'H2' THEN NULL WHEN heuristic = 'H6' THEN 'booking_authorized' ELSE reply_type END AS reply_type FROM p""")
def dpo_pairs_all(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of all eight heuristics without no-ops; fields of the rejected JSON tell what was spoiled."""
    # each text is read once, not once for each of its fields
    part = "struct<service_date:string,chef_id:string>"
    read = d.preference_pairs(cases(spark, sf)).select("id", "heuristic", F.from_json("rejected", f"action string, arguments {part}, booking_state {part}, candidate_chefs array<string>, reply_type string").alias("r"))
    return read.select(
        "id", "heuristic", "r.action", F.coalesce("r.arguments.service_date", "r.booking_state.service_date").alias("service_date"), F.col("r.booking_state.chef_id").alias("chef_id"),
        F.get("r.candidate_chefs", F.lit(0)).alias("first_candidate"), F.col("r.reply_type").alias("reply_type"),
    )


@query(_CASES + ", p AS (" + " UNION ALL ".join(f"SELECT *, '{h}' AS heuristic FROM c WHERE {on}" for h, on in _PAIRS.items()) + ") SELECT heuristic, count(*) AS n, count(*) AS n_valid_chosen, count(*) AS n_valid_rejected, count(*) AS n_different FROM p GROUP BY heuristic")
def pair_quality_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs by heuristic: those whose sides parse as decisions, and whose sides and digests differ."""
    valid = lambda c: F.from_json(c, d.DECISION_TYPE)["action"].isin("tool_call", "final")
    return d.preference_pairs(cases(spark, sf)).groupBy("heuristic").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(valid("chosen")).alias("n_valid_chosen"), F.count_if(valid("rejected")).alias("n_valid_rejected"), F.count_if(F.col("chosen_sha256") != F.col("rejected_sha256")).alias("n_different")
    )
