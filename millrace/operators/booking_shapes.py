"""Shapes of the records of booking conversations: slots, decisions, tool results, messages, inputs and samples.

Fixed values: names of fields, tags and patterns are those of the contract.
"""

from __future__ import annotations

from millrace.operators.shapes import ANY_OBJECT, DAY, FLAG, NULL, NUMBER, TEXT, WHOLE, Having, Inside, Items, Leaf, Nullable, Record, Union, one_of, optional

TIME = Leaf("text", pattern=r"^([01]\d|2[0-3]):[0-5]\d$")
QUERY_STATUS = one_of("not_checked", "matched", "available", "unavailable", "not_found", "no_match", "out_of_service_area", "error")
REPLY_TYPE = one_of(
    "handoff", "ask_service_date", "ask_start_time", "ask_people", "ask_address", "ask_multiple_required_fields", "present_chef_candidates", "confirm_specific_chef", "present_alternatives", "inform_not_found", "inform_no_match",
    "inform_out_of_service_area", "booking_authorized", "booking_paused", "acknowledge_result",
)
CHEF = Record({"chef_id": TEXT, "chef_name": TEXT})
_TEXT, _TEXTS = Nullable(TEXT), Items(TEXT)
ARGUMENTS = {
    "chef_name": _TEXT, "service_date": Nullable(DAY), "start_time": Nullable(TIME), "people": Nullable(WHOLE), "address": _TEXT, "cuisine": _TEXT, "budget_min": Nullable(NUMBER), "budget_max": Nullable(NUMBER), "menu": _TEXTS,
    "ingredient_purchase": Nullable(FLAG), "dietary_constraints": _TEXTS, "occasion": _TEXT,
}
SEARCH = Record(ARGUMENTS)
SLOT = optional(ARGUMENTS | {"chef_id": _TEXT, "confirmation": Nullable(FLAG)})
TOOL_CALL = Record({"action": one_of("tool_call"), "tool_name": one_of("find_chefs"), "arguments": SEARCH}, frozenset({"action", "tool_name"}))
FINAL = optional(
    {"action": one_of("final"), "candidate_chefs": Items(CHEF), "missing_info": _TEXTS, "reply": _TEXT},
    booking_state=SLOT, chef_query_status=QUERY_STATUS, info_complete=FLAG, unrelated=FLAG, reply_type=REPLY_TYPE,
)
DECISION = Union(("action",), {("tool_call",): TOOL_CALL, ("final",): FINAL})


def _result(mode: str, status: str, **more) -> Record:
    return Record({"mode": one_of(mode), "status": one_of(status), **more})


_NOBODY, _FAILED = Items(CHEF, most=0), {"error_code": TEXT, "retryable": FLAG, "message": TEXT}
RESULT = Union(("mode", "status"), {
    ("search", "matched"): _result("search", "matched", candidates=Items(CHEF, 1)),
    ("search", "no_match"): _result("search", "no_match", candidates=_NOBODY),
    ("search", "out_of_service_area"): _result("search", "out_of_service_area", candidates=_NOBODY),
    ("search", "error"): _result("search", "error", **_FAILED),
    ("specific", "available"): _result("specific", "available", chef=CHEF),
    ("specific", "unavailable"): _result("specific", "unavailable", requested_chef=TEXT, alternatives=Items(CHEF)),
    ("specific", "not_found"): _result("specific", "not_found", requested_chef=TEXT, alternatives=_NOBODY),
    ("specific", "out_of_service_area"): _result("specific", "out_of_service_area", requested_chef=TEXT, alternatives=_NOBODY),
    ("specific", "error"): _result("specific", "error", **_FAILED),
})
_CALL = Record({"id": TEXT, "type": one_of("function"), "function": Record({"name": one_of("find_chefs"), "arguments": TEXT})})


def _message(call: Record, content) -> Union:
    asks = Record({"role": one_of("assistant"), "content": NULL, "tool_calls": Items(call, 1, 1)}, frozenset({"content"}))
    return Union(("role",), {
        ("user",): Record({"role": one_of("user"), "content": TEXT}),
        ("assistant",): Having("tool_calls", asks, Record({"role": one_of("assistant"), "content": _TEXT})),
        ("tool",): Record({"role": one_of("tool"), "tool_call_id": TEXT, "name": one_of("find_chefs"), "content": content}),
    })


MESSAGE = _message(_CALL, TEXT)
#: A message whose call's arguments and whose result are looked into.
WHOLE_MESSAGE = _message(Record(_CALL.fields | {"function": Record({"name": one_of("find_chefs"), "arguments": Inside(SEARCH)})}), Inside(RESULT))
TOOL_SPEC = Record({"type": one_of("function"), "function": Record({"name": one_of("find_chefs"), "description": TEXT, "parameters": ANY_OBJECT})})
STATE = optional({"chef_query_status": QUERY_STATUS, "candidate_chefs": Items(CHEF), "awaiting_confirmation": FLAG}, booking_state=SLOT)
INPUT = optional(
    {"history": Items(WHOLE_MESSAGE), "user_input": _TEXT, "available_tools": Items(TOOL_SPEC)},
    current_state=STATE, current_time=Leaf("text", pattern=r"^\d{4}-\d{2}-\d{2} ([01]\d|2[0-3]):[0-5]\d$"),
)
TARGETS = tuple(f"H{i}" for i in range(1, 10))
_GENERATION = optional({
    "generator": TEXT, "model": TEXT, "seed": WHOLE, "scenario": TEXT, "capability_tags": _TEXTS, "template_id": TEXT, "difficulty": one_of("easy", "medium", "hard"),
    "relative_time_metadata": Nullable(optional({"relative_expression": TEXT, "correction_type": _TEXT}, expression_type=TEXT, base_datetime=TEXT, resolved_service_date=TEXT)),
    "state_transition_metadata": Nullable(optional({"changed_fields": _TEXTS, "preserved_fields": _TEXTS, "invalidated_fields": _TEXTS})),
    "tool_fact_metadata": Nullable(optional({"tool_mode": TEXT, "tool_result_status": TEXT, "requested_chef": _TEXT, "candidate_ids": _TEXTS, "candidate_order": _TEXTS, "evidence_fields": _TEXTS})),
}, prompt_sha256=Leaf("text", pattern=r"^[\s\S]{64}$"), generated_at=TEXT)


def sample(contract: str) -> Record:
    """A raw sample made under the contract of this name."""
    return optional(
        {
            "contract_id": one_of(contract), "source": one_of("synthetic"), "tags": _TEXTS, "dpo_targets": Items(one_of(*TARGETS)),
            "review": optional({"status": one_of("machine_validated", "human_reviewed", "rejected"), "reviewer": _TEXT, "notes": _TEXTS}),
        },
        id=TEXT, dataset_version=TEXT, scenario=TEXT, output_kind=one_of("tool_call", "final"), conversation_kind=one_of("single_turn", "multi_turn"), input=INPUT, expected=DECISION, generation=_GENERATION,
    )


_SAID = Record({"role": TEXT, "content": TEXT})
_SHA256 = Leaf("text", pattern=r"^[\s\S]{64}$")
SFT_ROW = optional({"tags": _TEXTS}, id=TEXT, raw_id=TEXT, dataset_version=TEXT, messages=Items(_SAID), prompt_sha256=_SHA256, completion_sha256=_SHA256)
DPO_ROW = optional({"tags": _TEXTS}, id=TEXT, raw_id=TEXT, dataset_version=TEXT, heuristic=TEXT, prompt=Items(_SAID), chosen=TEXT, rejected=TEXT, chosen_sha256=_SHA256, rejected_sha256=_SHA256)
