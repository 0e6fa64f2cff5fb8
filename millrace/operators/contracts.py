"""Rules that answers, specifications of tools and cases of an evaluation must keep, and the shapes that training and reports take them in.

Rules over a whole decision take the nested case of ``operators.decisions``; the others take the columns they name. Each is a column over one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators.booking_shapes import DECISION
from millrace.operators.decisions import SLOTS, has_any
from millrace.operators.rules import issues
from millrace.operators.shapes import let, problems

#: Scenarios in which a false authorization may be made of an answer.
CHOICE_SCENARIOS = ("candidate_selection", "specific_available", "matched_candidates", "specific_unavailable")
SPACE = " \t\n\x0b\x0c\r"


def state_issues() -> Column:
    """What a predicted final answer breaks: facts kept after a search slot has changed, an authorization without its grounds, and a status lost on selection.

    A chef's name that was open and is now given is a selection, no change. ``evidence.latest_status`` is the status before the turn."""
    p, before = "predicted.booking_state", F.col("evidence.latest_status")
    final = F.col("predicted.action").eqNullSafe("final")
    differs = lambda s: ~F.col(f"{p}.{s}").eqNullSafe(F.col(f"state.{s}"))
    chosen = F.col("state.chef_name").isNull() & F.col(f"{p}.chef_name").isNotNull()
    changed = final & reduce(lambda a, b: a | b, [differs(s) & ~chosen if s == "chef_name" else differs(s) for s in SLOTS])
    chef, status = F.col(f"{p}.chef_id"), F.col("predicted.chef_query_status")
    authorized = final & F.col("predicted.reply_type").eqNullSafe("booking_authorized")
    kept = lambda value: final & chef.isNotNull() & (before == value) & ~status.eqNullSafe(value)
    return issues(
        ("candidates_after_change", changed & (F.size("predicted.candidate_chefs") > 0)),
        ("chef_after_change", changed & chef.isNotNull()),
        ("status_after_change", changed & ~status.eqNullSafe("not_checked")),
        ("confirmation_after_change", changed & F.col(f"{p}.confirmation")),
        ("authorized_not_awaited", authorized & ~F.col("awaiting_confirmation")),
        ("authorized_without_chef", authorized & chef.isNull()),
        ("authorized_unverified_chef", authorized & ~F.array_contains("evidence.verified_ids", chef)),
        ("authorized_without_consent", authorized & F.col("user_input").isNotNull() & ~tx.is_affirmative(F.col("user_input"))),
        ("matched_status_lost", kept("matched")),
        ("unavailable_status_lost", kept("unavailable")),
    )


def may_be_falsely_authorized() -> Column:
    """Whether a false authorization can be made of the expected answer: a final one in a scenario of choice, neither authorized nor confirmed, with a chef or candidates."""
    e = "expected.booking_state"
    some_chef = (F.coalesce(F.size("expected.candidate_chefs"), F.lit(0)) > 0) | F.col(f"{e}.chef_id").isNotNull()
    open_ = ~F.col("expected.reply_type").eqNullSafe("booking_authorized") & ~F.coalesce(F.col(f"{e}.confirmation"), F.lit(False))
    return F.coalesce((F.col("expected.action") == "final") & F.col("scenario").isin(*CHOICE_SCENARIOS) & open_ & some_chef, F.lit(False))


def protocol_error(raw: Column) -> Column:
    """Why a model's text isn't a decision, null where it is: missing_raw_text, markdown_fence, JSONDecodeError, not_object or ValidationError (any fault of its structure)."""

    def of_text(t: Column) -> Column:
        # a trimmed JSON text tells an object by its first character, without the schema of the whole
        parsed = lambda v: F.when(v.isNull(), "JSONDecodeError").when(~t.startswith("{"), "not_object").when(F.size(problems(DECISION, v)) > 0, "ValidationError")
        return F.when(t.startswith("```") | t.endswith("```"), "markdown_fence").otherwise(let(F.try_parse_json(t), parsed))

    return F.when(raw.isNull(), "missing_raw_text").otherwise(let(F.btrim(raw, F.lit(SPACE)), of_text))


def _definition(prop: Column) -> Column:
    """A property's JSON as sorted entries, its list of types in order."""
    types = lambda v: F.array_join(F.array_sort(F.regexp_extract_all(v, F.lit(r"(\w+)"))), "|")
    fields = F.transform_values(F.from_json(prop, "map<string,string>"), lambda k, v: F.when(k == "type", types(v)).otherwise(v))
    return F.array_sort(F.map_entries(fields))


def tool_schema_issue(spec: Column, canonical: Column) -> Column:
    """The first rule that the JSON of a tool's parameters breaks, null if none: an object, closed, with just the keys of ``canonical`` required and defined, each alike but for the order of types."""
    shape = "struct<type:string,additionalProperties:boolean,required:array<string>,properties:map<string,string>>"
    s, c = F.from_json(spec, shape), F.from_json(canonical, shape)["properties"]
    keys = F.array_sort(F.map_keys(c))
    other = F.exists(keys, lambda k: ~_definition(s["properties"][k]).eqNullSafe(_definition(c[k])))
    return (
        F.when(~s["type"].eqNullSafe("object"), "type")
        .when(~s["additionalProperties"].eqNullSafe(False), "additionalProperties")
        .when(~F.array_sort(s["required"]).eqNullSafe(keys), "required")
        .when(~F.array_sort(F.map_keys(s["properties"])).eqNullSafe(keys), "keys")
        .when(other, "definition")
    )


def latest_results(messages: DataFrame) -> DataFrame:
    """Per conversation the status, requested chef and order of chefs of its last tool result that answers an earlier call.

    ``messages`` has conv, pos, role (assistant or tool), call_id and content: a call's arguments or a result, as JSON. Chefs are the candidates, else the alternatives, else the one chef.
    A result without its call before it proves nothing; of several calls of one id before it the last counts, and of two results at one position the greater."""
    one = "struct<chef_id:string>"
    result = F.from_json("content", f"struct<status:string,candidates:array<{one}>,alternatives:array<{one}>,chef:{one}>")
    calls = messages.where("role = 'assistant'").select("conv", "call_id", F.col("pos").alias("asked_at"), F.get_json_object("content", "$.chef_name").alias("requested"))
    results = messages.where("role = 'tool'").select("conv", "call_id", "pos", result.alias("r"))
    chefs = F.coalesce("r.candidates", "r.alternatives", F.when(F.col("r.chef").isNotNull(), F.array("r.chef")))
    order = F.coalesce(F.array_join(F.transform(chefs, lambda x: x["chef_id"]), ","), F.lit(""))
    found = results.join(calls, ["conv", "call_id"]).where("asked_at < pos").select("conv", F.struct("pos", "asked_at", F.col("r.status").alias("status"), "requested", order.alias("chef_order")).alias("x"))
    return found.groupBy("conv").agg(F.max("x").alias("x")).select("conv", "x.*").drop("asked_at")


def case_issues(cases: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Rows (id, issue) of evaluation cases (id, case_id, output_kind, action, assertions, user_input, last_user, n_tools) that break a rule of the suite.

    The first of several rows with one case_id is the one with the least id."""
    first = cases.groupBy("case_id").agg(F.min("id").alias("first_id"))
    found = issues(
        ("duplicate_id", F.col("id") != F.col("first_id")),
        ("output_kind", F.col("output_kind") != F.col("action")),
        ("unknown_assertion", F.size(F.array_except("assertions", F.array(*map(F.lit, known)))) > 0),
        ("user_said_twice", F.col("user_input") == F.col("last_user")),
        ("no_tools", (F.col("output_kind") == "tool_call") & (F.col("n_tools") == 0)),
    )
    return cases.join(first, "case_id").select("id", F.explode(found).alias("issue"))


def allowed_keys(fields: Column, allowed: tuple[str, ...]) -> Column:
    """A map without the keys that aren't allowed."""
    return F.map_filter(fields, lambda k, _: k.isin(*allowed))


def scorecard_metrics(card: Column) -> dict[str, Column]:
    """The common columns of both shapes of scorecards (rates at the top, or under ``metrics``). A rate of zero is a rate."""
    at = lambda path: F.get_json_object(card, f"$.{path}").cast("double")
    either = ("protocol_pass_rate", "effective_pass_rate", "mean_task_correctness", "critical_error_rate")
    out = {m: F.coalesce(at(m), at(f"metrics.{m}")) for m in either}
    out |= {m: at(f"performance.{m}") for m in ("p95_latency_s", "mean_ttft_s", "mean_tokens_per_second")}
    return out | {"tool_timing": at("metrics.metrics.tool_timing_accuracy"), "state_inheritance": at("metrics.metrics.state_inheritance_accuracy")}


def trainer_pair(messages: Column, chosen: Column, rejected: Column) -> dict[str, Column]:
    """A preference pair in one turn: the whole prompt as JSON in one user message, and an answer on either side."""
    said = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    return {"conversations": F.array(said("user", F.to_json(messages))), "chosen": said("assistant", chosen), "rejected": said("assistant", rejected)}


#: Cues of what a turn asks for, one of which a rewrite must keep.
INTENT_CUES = {
    "modification": ("改成", "换", "换成", "改到", "调整", "从", "改为", "提到", "提高到", "不是", "说错", "纠正", "其实", "应该是"),
    "requery": ("重新", "再查", "再帮", "重新帮我", "还有没有", "重新看看", "再看看"),
    "confirmation": ("可以", "确认", "好的", "就这样", "就订", "订"),
    "rejection": ("不订", "算了", "取消", "先别订", "不要"),
}


def lost_fact(values: Column, said: Column, rewritten: Column) -> Column:
    """What a rewrite of a turn loses first, null if nothing: ``value`` (one of the turn's values), or an intent of which it keeps no cue.

    Null and empty values aren't asked for; a null rewrite loses all."""
    text = F.coalesce(rewritten, F.lit(""))
    out = F.when(F.exists(F.array_compact(values), lambda v: (v != "") & ~F.contains(text, v)), "value")
    for intent, cues in INTENT_CUES.items():
        out = out.when(has_any(said, cues) & ~has_any(text, cues), intent)
    return out
