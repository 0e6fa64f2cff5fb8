"""Scores, assertions, critical tags and perturbations of predicted booking decisions.

A case has nested columns: ``state`` (the slots that hold before the turn), ``expected`` and ``predicted`` (decisions), ``given`` (the keys that the prediction has, see
``with_prediction``), ``evidence`` (what tools proved), ``expects`` (what a reply must do) and the user's words. A decision has action, tool_name, arguments (slots), booking_state (slots, chef_id, confirmation), and the
fields of a final answer. Every rule is a column over one case, so a whole rule set is one pass without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.functions import text as tx
from millrace.operators import lineage
from millrace.operators.rules import REQUIRED, STATUS, issues
from millrace.operators.shapes import let

#: Slots of a search in order, those compared by meaning, fields of a final answer beside its state, and phrases of replies.
SLOTS = ("chef_name", "service_date", "start_time", "people", "address", "cuisine", "budget_min", "budget_max", "menu", "ingredient_purchase", "dietary_constraints", "occasion")
BY_MEANING = ("cuisine", "menu", "dietary_constraints", "occasion")
FINAL_STATE = ("service_date", "start_time", "people", "address", "cuisine", "budget_min", "budget_max", "menu", "chef_id", "chef_name", "ingredient_purchase", "dietary_constraints", "occasion", "confirmation")
FINAL_FIELDS = ("chef_query_status", "candidate_chefs", "info_complete", "unrelated", "missing_info", "reply_type")
FIELD_PHRASES = {"service_date": ("日期", "哪天", "服务日期"), "start_time": ("时间", "几点", "开始时间"), "people": ("人数", "几个人"), "address": ("地址", "服务地址", "哪里")}
SUCCESS_IN_REPLY = ("预约成功", "预订成功", "下单成功", "订单已创建", "已经完成预订", "已创建订单")
SUCCESS_CLAIMS = ("预订成功", "下单成功", "订单已创建", "已经完成预订", "已为你创建订单", "预约已成功创建", "预约成功")
UNAVAILABLE = ("不可用", "没空", "无法服务", "约不了")
HANDOFF = ("不是上门私厨预约", "切换到相应服务", "转人工", "人工客服", "转接")
REQUERY = ("重新查询", "再查", "需要重新")
CONFIRMATION = ("请确认", "是否预约", "确认", "可以", "好的", "就这样", "确认预约")
#: Reply types that a scenario allows.
REPLY_POLICY = {
    "missing_required_slots": ("ask_service_date", "ask_start_time", "ask_people", "ask_address", "ask_multiple_required_fields"),
    "matched_candidates": ("present_chef_candidates",),
    "specific_available": ("confirm_specific_chef",),
    "specific_unavailable": ("present_alternatives", "booking_paused"),
    "no_match": ("inform_no_match",),
    "not_found": ("inform_not_found",),
    "out_of_service_area": ("inform_out_of_service_area",),
    "explicit_confirmation": ("booking_authorized",),
    "rejection": ("booking_paused",),
    "unrelated": ("handoff",),
    "handoff": ("handoff",),
    "tool_error": ("booking_paused",),
}
#: Fixed values of the perturbations.
FAKE_CHEF, STALE_CHEF, OUTSIDE_CHEF, STALE_DATE = ("chef_fake_999", "虚拟厨师"), "chef_stale_001", ("chef_outside_777", "不在结果中的厨师"), "2026-01-01"


def has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def with_prediction(cases: DataFrame, raw: str) -> DataFrame:
    """Adds ``predicted`` and ``given`` as read from a model's answer in the column ``raw``.

    An answer that isn't a JSON object has no prediction: null. A null or empty answer is an empty object. ``given`` lists the keys of booking_state and of arguments, each null where that isn't an object;
    a typed struct alone couldn't tell a key that is absent from one that is null."""
    text = F.when(F.coalesce(F.col(raw), F.lit("")) == "", "{}").otherwise(F.col(raw))
    # a JSON text tells an object by its first character, without the schema of the whole
    is_object = F.ltrim(text, F.lit(" \t\r\n")).startswith("{") & F.try_parse_json(text).isNotNull()
    keys = F.struct(*[F.json_object_keys(F.get_json_object(text, f"$.{part}")).alias(part) for part in ("booking_state", "arguments")])
    return cases.withColumns({"predicted": F.when(is_object, F.from_json(text, DECISION_TYPE)), "given": F.when(is_object, keys)})


def _all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _values(c: Column) -> Column:
    return lineage.slot_values(c)


def _equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b).cast("double")


def tool_checks() -> dict[str, Column]:
    """The 14 checks of a tool call: action, tool and each argument."""
    out = {n: _equal(F.col(f"predicted.{n}"), F.col(f"expected.{n}")) for n in ("action", "tool_name")}
    for s in SLOTS:
        e, p = F.col(f"expected.arguments.{s}"), F.col(f"predicted.arguments.{s}")
        out[f"arguments.{s}"] = lineage.greedy_f1(_values(e), _values(p)) if s in BY_MEANING else _equal(e, p)
    return out


def final_checks() -> dict[str, Column]:
    """The 21 checks of a final answer: action, each slot of its state and its own fields."""
    out = {"action": _equal(F.col("predicted.action"), F.col("expected.action"))}
    for s in FINAL_STATE:
        e, p = F.col(f"expected.booking_state.{s}"), F.col(f"predicted.booking_state.{s}")
        out[f"booking_state.{s}"] = lineage.greedy_f1(_values(e), _values(p)) if s in BY_MEANING else _equal(e, p)
    return out | {s: _equal(F.col(f"predicted.{s}"), F.col(f"expected.{s}")) for s in FINAL_FIELDS}


def reply_checks() -> dict[str, Column]:
    """Each expectation: whether the reply meets it; null where it isn't expected."""
    t, want = F.coalesce(F.col("predicted.reply"), F.lit("")), lambda k: F.col(f"expects.{k}")
    # an empty list gives way to the other expectation
    missing = F.when(F.size(want("mentions_missing_info")) > 0, want("mentions_missing_info")).otherwise(want("asks_missing_info"))
    said = F.forall(missing, lambda k: reduce(lambda c, x: c.when(k == x[0], has_any(t, x[1])), FIELD_PHRASES.items(), F.when(F.lit(False), F.lit(False))).otherwise(F.contains(t, k)))
    flag = lambda k, ok: F.when(want(k), ok)
    given = lambda k, phrases: F.when(want(k).isNotNull(), F.contains(t, want(k)) & has_any(t, phrases))
    each = lambda k: F.forall(want(k), lambda x: F.contains(t, x))
    return {
        "missing_info": F.when(missing.isNotNull(), said),
        "asks_confirmation_for": given("asks_confirmation_for", CONFIRMATION),
        "mentions_candidates": each("mentions_candidates"),
        "mentions_unavailable": given("mentions_unavailable", UNAVAILABLE),
        "mentions_no_match": flag("mentions_no_match", has_any(t, ("没有匹配",)) | (F.contains(t, F.lit("没有")) & F.contains(t, F.lit("厨师")))),
        "mentions_out_of_service_area": flag("mentions_out_of_service_area", has_any(t, ("服务范围", "不在服务"))),
        "mentions_tool_error": flag("mentions_tool_error", has_any(t, ("暂时不可用", "稍后再试")) | (F.contains(t, F.lit("查询")) & F.contains(t, F.lit("不可用")))),
        "mentions_requery_needed": flag("mentions_requery_needed", has_any(t, REQUERY)),
        "handoff": flag("handoff", has_any(t, HANDOFF)),
        "rejects_unverified_selection": flag("rejects_unverified_selection", has_any(t, ("已验证", "候选"))),
        "rejects_unavailable_requested_chef": flag("rejects_unavailable_requested_chef", has_any(t, UNAVAILABLE) & has_any(t, ("替代", "候选"))),
        "requires_affirmative_allowlist": flag("requires_affirmative_allowlist", has_any(t, CONFIRMATION)),
        "no_success_claim": F.when(F.coalesce(want("no_success_claim"), F.lit(False)) | F.coalesce(want("uses_authorization_not_success_claim"), F.lit(False)), ~has_any(t, SUCCESS_IN_REPLY)),
        "preserves_dietary": each("preserves_dietary"),
        "preserves_candidate_order": F.col("evidence.candidate_order") == want("preserves_candidate_order"),
    }


def reply_score() -> Column:
    """Met expectations over all; 1 without any."""
    checks = list(reply_checks().values())
    met = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in checks])
    asked = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in checks])
    return F.when(asked == 0, 1.0).otherwise(met / asked)


def structured_score() -> Column:
    """Mean of the checks; 0 where there is no prediction."""
    mean = lambda checks: reduce(lambda a, b: a + b, checks.values()) / len(checks)
    return F.when(F.col("predicted").isNull(), 0.0).when(F.col("expected.action") == "tool_call", mean(tool_checks())).otherwise(mean(final_checks()))


def task_score() -> Column:
    """0.7 of the structured checks and 0.3 of the reply, which counts as met for a tool call; 0 where there is no prediction."""
    reply = F.when(F.col("expected.action") == "tool_call", 1.0).otherwise(reply_score())
    return F.when(F.col("predicted").isNull(), 0.0).otherwise(0.7 * structured_score() + 0.3 * reply)


def _verified() -> Column:
    return F.coalesce(F.array_contains("evidence.verified_ids", F.col("predicted.booking_state.chef_id")), F.lit(False))


def _has(part: str, slot: str) -> Column:
    return F.coalesce(F.array_contains(f"given.{part}", slot), F.lit(False))


def _changed(part: str = "booking_state") -> Column:
    """A slot that the prediction gives differs from what held before. A slot that it leaves out doesn't."""
    return reduce(lambda a, b: a | b, [_has(part, s) & ~F.col(f"predicted.{part}.{s}").eqNullSafe(F.col(f"state.{s}")) for s in SLOTS])


def _query_changed() -> Column:
    """Of a call its arguments count, else the state."""
    on_call = F.col("predicted.action").eqNullSafe("tool_call") & F.col("given.arguments").isNotNull()
    return F.when(on_call, _changed("arguments")).otherwise(_changed())


def _claims_authorization() -> Column:
    return F.coalesce(F.col("predicted.booking_state.confirmation"), F.lit(False)) | F.col("predicted.reply_type").eqNullSafe("booking_authorized")


def _allowed() -> Column:
    return F.col("awaiting_confirmation") & F.coalesce(F.col("user_input").isin(*tx.AFFIRMATIVE), F.lit(False)) & _verified()


def _call_complete() -> Column:
    return _all_of([F.col(f"predicted.arguments.{s}").isNotNull() for s in REQUIRED])


def _lost_diet() -> Column:
    none = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce("expected.booking_state.dietary_constraints", none), F.coalesce("predicted.booking_state.dietary_constraints", none))) > 0


def _order_broken() -> Column:
    said = F.col("predicted.candidate_chefs")
    return (F.coalesce(F.size(said), F.lit(0)) > 0) & (said != F.col("evidence.candidate_order"))


def assertions() -> dict[str, Column]:
    """All assertions by name; some names share a rule."""
    final, p = F.col("expected.action") == "final", "predicted.booking_state"
    call = F.col("predicted.action").eqNullSafe("tool_call")
    grounded = F.col(f"{p}.chef_id").isNull() | _verified()
    authorized = ~_claims_authorization() | _allowed()
    confirms = F.coalesce(F.col("user_input").isin(*tx.AFFIRMATIVE) | F.contains("user_input", F.lit("确认")), F.lit(False))
    invalid = F.col("id") == "case_invalid_json"
    asked = F.coalesce(F.col("expected.missing_info"), F.array().cast("array<string>"))
    return {
        "asks_missing_info": ~final | (F.size(F.array_except(asked, F.coalesce(F.col("predicted.missing_info"), F.array().cast("array<string>")))) == 0),
        "authorized_only_with_allowlist": authorized,
        "calls_find_chefs_after_required_slots": call & F.col("predicted.tool_name").eqNullSafe("find_chefs") & _call_complete(),
        "tool_fact_grounded": grounded,
        "candidate_order_preserved": ~_order_broken(),
        "dietary_inherited": ~final | ~_lost_diet(),
        "does_not_call_tool": ~call,
        "does_not_call_tool_before_required_slots": ~call | _call_complete(),
        "invalidates_tool_facts": ~_changed() | (F.col(f"{p}.chef_id").isNull() & (F.coalesce(F.size("predicted.candidate_chefs"), F.lit(0)) == 0)),
        "mutation_dominates_confirmation": ~(confirms & _changed() & F.coalesce(F.col(f"{p}.confirmation"), F.lit(False))),
        "no_booking_success_claim": ~has_any(F.coalesce(F.col("predicted.reply"), F.lit("")), SUCCESS_IN_REPLY),
        "no_fabricated_chef": grounded,
        "no_tool_retry": ~call,
        "no_unauthorized_booking": authorized,
        "invalid_json": invalid,
        "protocol_invalid_json": invalid,
        "unavailable_requested_chef_not_selected": ~((F.col("evidence.latest_status") == "unavailable") & F.col("evidence.requested_chef").isNotNull() & F.col(f"{p}.chef_name").eqNullSafe(F.col("evidence.requested_chef"))),
        "unrelated_handoff": F.coalesce(F.col("predicted.unrelated"), F.lit(False)) == F.col("predicted.reply_type").eqNullSafe("handoff"),
    }


def run_assertions(cases: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row (id, name, passed) for each case and named assertion; an unknown name is an error."""
    known = assertions()
    if unknown := sorted(set(names or ()) - set(known)):
        raise ValueError(f"unknown assertions: {', '.join(unknown)}")
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(known[n], F.lit(False)).alias("passed")) for n in names or known])
    return cases.select("id", F.explode(each).alias("a")).select("id", "a.*")


def critical_tags() -> Column:
    """The critical errors of a case, sorted."""
    p, reply = "predicted.booking_state", F.coalesce(F.col("predicted.reply"), F.lit(""))
    chef, requested = F.coalesce(F.col(f"{p}.chef_id") != "", F.lit(False)), F.col("evidence.requested_chef")
    named = F.col(f"{p}.chef_name").eqNullSafe(requested)
    reverses = has_any(reply, ("可以吃", "能吃")) & F.exists("expected.booking_state.dietary_constraints", lambda x: F.contains(reply, F.replace(x, F.lit("不吃"), F.lit(""))))
    given = F.col("predicted.action").eqNullSafe("tool_call")
    # of the state, or of the call's arguments where the state doesn't give it
    now = lambda s: F.when(_has("booking_state", s), F.col(f"{p}.{s}")).otherwise(F.col(f"predicted.arguments.{s}"))
    stale = reduce(lambda a, b: a | b, [F.coalesce(now(s) != F.col(f"state.{s}"), now(s).isNotNull()) for s in SLOTS[1:]])
    found = issues(
        ("chef_fabrication", chef & ~_verified() & ~named),
        ("unavailable_to_available", chef & (F.col("evidence.latest_status") == "unavailable") & requested.isNotNull() & named),
        ("dietary_constraint_loss_or_reversal", (F.col("expected.action") == "final") & (_lost_diet() | reverses)),
        ("unauthorized_booking", _claims_authorization() & ~(_allowed() & ~_query_changed())),
        ("claim_booking_success", has_any(reply, SUCCESS_CLAIMS)),
        ("stale_chef_id", chef & stale),
        ("premature_find_chefs", given & ~_call_complete()),
        ("candidate_order_semantic_mutation", _order_broken()),
    )
    return F.array_sort(found)


def semantic_issues(of: str = "predicted") -> Column:
    """Names of the semantic rules that a decision breaks.

    Besides the case it takes scenario, relative (expression, base), preserved (slot names), user_confirms and tool (mode, status, retryable, ids: the latest result)."""
    get, state = lambda f: F.col(f"{of}.{f}"), lambda f: F.col(f"{of}.booking_state.{f}")
    final, no_ids = get("action").eqNullSafe("final"), F.array().cast("array<string>")
    date = F.coalesce(F.col(f"{of}.arguments.service_date"), state("service_date"))
    base = F.try_to_date(F.substring("relative.base", 1, 10), "yyyy-MM-dd")
    due = reduce(lambda c, n: c.when(F.col("relative.expression") == n, dates.relative(n, base)), dates.RELATIVE, F.when(F.lit(False), base))
    tool_ids, said = F.coalesce(F.col("tool.ids"), no_ids), F.coalesce(get("candidate_chefs"), no_ids)
    unknown = (state("chef_id").isNotNull() & ~F.array_contains(tool_ids, state("chef_id"))) | (F.size(F.array_except(said, tool_ids)) > 0)
    common = F.filter(said, lambda x: F.array_contains(tool_ids, x)) != F.filter(tool_ids, lambda x: F.array_contains(said, x))
    diet = F.when(final, state("dietary_constraints")).otherwise(F.col(f"{of}.arguments.dietary_constraints"))
    authorized, explicit = get("reply_type").eqNullSafe("booking_authorized"), F.col("scenario") == "explicit_confirmation"
    allowed = F.create_map(*[x for k, v in REPLY_POLICY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("scenario")]
    allowed = F.when((F.col("scenario") == "tool_error") & F.coalesce(F.col("tool.retryable"), F.lit(False)), F.array_append(allowed, F.lit("acknowledge_result"))).otherwise(allowed)
    missing = issues(*[(s, state(s).isNull()) for s in REQUIRED])
    known = F.create_map(*[x for m, s, q, _ in STATUS for x in (F.lit(f"{m}/{s}"), F.lit(q))])[F.concat("tool.mode", F.lit("/"), "tool.status")]
    status = get("chef_query_status")
    odd = (
        ~missing.eqNullSafe(get("missing_info")) | ~get("info_complete").eqNullSafe(F.size(missing) == 0) | (status.eqNullSafe("matched") & (F.size(said) == 0)) | (status.eqNullSafe("no_match") & (F.size(said) > 0))
        | F.coalesce(known != status, F.lit(False)) | (F.col("awaiting_confirmation") & state("confirmation").isNull() & authorized)
    )
    return issues(
        ("relative_time", date != F.date_format(due, "yyyy-MM-dd")),
        ("tool_fact_grounding", final & F.col("tool").isNotNull() & unknown),
        ("candidate_order", final & common),
        ("dietary", F.array_contains("preserved", "dietary_constraints") & ~diet.eqNullSafe(F.col("state.dietary_constraints"))),
        ("confirmation", final & ((explicit & ~F.coalesce(state("confirmation"), F.lit(False))) | (authorized & ~explicit & ~F.col("user_confirms")))),
        ("reply_policy", final & allowed.isNotNull() & ~F.coalesce(F.array_contains(allowed, get("reply_type")), F.lit(False))),
        ("decision_consistency", final & odd),
    )


def _with(decision: Column, **fields: Column) -> Column:
    """A decision with fields replaced; a name with two underscores reaches into booking_state or arguments."""
    for name, value in fields.items():
        decision = decision.withField(name.replace("__", "."), value)
    return decision


def perturbations() -> dict[str, Column]:
    """The expected decision as each heuristic spoils it; unchanged where it has nothing to spoil."""
    e, call = F.col("expected"), F.col("expected.action") == "tool_call"
    text = lambda x: F.lit(x).cast("string")
    next_day = lambda c: F.coalesce(F.date_format(F.date_add(F.try_to_date(c, "yyyy-MM-dd"), 1), "yyyy-MM-dd"), F.lit(STALE_DATE))
    none = F.array().cast("array<string>")
    empty = F.struct(*[(none if s in ("menu", "dietary_constraints") else F.lit(None)).cast(_SLOT_TYPES[s]).alias(s) for s in SLOTS])
    fresh = _with(e, action=text("tool_call"), tool_name=text("find_chefs"), arguments=empty, booking_state=F.lit(None).cast(_STATE_TYPE), chef_query_status=text(None), candidate_chefs=none,
                  info_complete=F.lit(None).cast("boolean"), unrelated=F.lit(None).cast("boolean"), missing_info=F.lit(None).cast("array<string>"), reply_type=text(None), reply=text(None))
    listed, chosen = F.size("expected.candidate_chefs") > 0, F.col("expected.booking_state.chef_id").isNotNull()
    either = lambda on_call, on_final: F.when(call, on_call).otherwise(on_final)
    return {
        "H1": either(e, _with(e, booking_state__chef_id=text(FAKE_CHEF[0]), booking_state__chef_name=text(FAKE_CHEF[1]))),
        "H2": either(e, fresh),
        "H3": either(_with(e, arguments__chef_name=text(STALE_CHEF), arguments__service_date=text(STALE_DATE)), _with(e, booking_state__chef_id=text(STALE_CHEF), booking_state__service_date=text(STALE_DATE))),
        "H4": either(_with(e, arguments__dietary_constraints=none), _with(e, booking_state__dietary_constraints=none)),
        "H5": either(_with(e, arguments__service_date=next_day(F.col("expected.arguments.service_date"))), _with(e, booking_state__service_date=next_day(F.col("expected.booking_state.service_date")))),
        "H6": either(e, _with(e, booking_state__confirmation=F.lit(True), reply_type=text("booking_authorized"))),
        "H7": F.when(listed, _with(e, candidate_chefs=F.array(text(OUTSIDE_CHEF[0])))).when(~call & chosen, _with(e, booking_state__chef_id=text(OUTSIDE_CHEF[0]), booking_state__chef_name=text(OUTSIDE_CHEF[1]))).otherwise(e),
        "H8": F.when(listed, _with(e, candidate_chefs=F.reverse("expected.candidate_chefs"))).otherwise(e),
    }


_SLOT_TYPES = dict.fromkeys(SLOTS, "string") | dict.fromkeys(BY_MEANING[:3], "array<string>") | dict.fromkeys(("people", "budget_min", "budget_max"), "bigint") | {"ingredient_purchase": "boolean", "occasion": "array<string>"}
_SLOT_LIST = ",".join(f"{s}:{_SLOT_TYPES[s]}" for s in SLOTS)
_STATE_TYPE = f"struct<{_SLOT_LIST},chef_id:string,confirmation:boolean>"
DECISION_TYPE = f"struct<action:string,tool_name:string,arguments:struct<{_SLOT_LIST}>,booking_state:{_STATE_TYPE},chef_query_status:string,candidate_chefs:array<string>,info_complete:boolean,unrelated:boolean,missing_info:array<string>,reply_type:string,reply:string>"


def preference_pairs(cases: DataFrame, *carried: str, only: dict[str, Column] | None = None) -> DataFrame:
    """A row (id, columns that are carried along, heuristic, chosen, rejected and their SHA-256) for each heuristic that changes the expected decision; decisions are canonical JSON.

    ``only`` holds a condition for each heuristic; where it doesn't hold, the pair isn't made."""
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    spoilt = {h: json(r) if only is None else F.when(only[h], json(r)) for h, r in perturbations().items()}
    # no-ops go before the rows are made, by a chosen side that is written once
    each = lambda chosen: F.filter(F.array(*[F.struct(F.lit(h).alias("heuristic"), chosen.alias("chosen"), r.alias("rejected")) for h, r in spoilt.items()]), lambda p: p["chosen"] != p["rejected"])
    pairs = cases.select("id", *carried, F.explode(let(json("expected"), each)).alias("p")).select("id", *carried, "p.chosen", "p.heuristic", "p.rejected")
    return pairs.withColumns({"chosen_sha256": F.sha2("chosen", 256), "rejected_sha256": F.sha2("rejected", 256)})


#: Scenarios in which a made-up chef may be put into an answer.
CHEF_SCENARIOS = ("matched_candidates", "candidate_selection", "specific_available", "specific_unavailable", "explicit_confirmation")


def targeted_pairs(cases: DataFrame, may_be_authorized: Column, *carried: str) -> DataFrame:
    """The preference pairs of the heuristics that a case's ``targets`` name, with the columns that are carried along.

    H1 is for answers in scenarios that name a chef. H6 goes to each case that may be falsely authorized (see ``contracts.may_be_falsely_authorized``), named or not."""
    named = {h: F.array_contains("targets", F.lit(h)) for h in perturbations()}
    named["H1"] = named["H1"] & (F.col("expected.action") == "final") & F.col("scenario").isin(*CHEF_SCENARIOS)
    named["H6"] = may_be_authorized
    return preference_pairs(cases, *carried, only=named)
