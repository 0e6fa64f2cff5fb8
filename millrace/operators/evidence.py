"""What the history of a conversation proves about chefs.

A history is an array of messages in order: role, call_id and content, where an assistant's message with a call_id is a call (content: its arguments as JSON), a tool's message a result.
One fold over the messages keeps the calls asked so far and what results have proved; nothing is exploded or shuffled. ``state`` is what held before the turn: candidate_chefs, booking_state (chef_id, chef_name) and chef_query_status.

A result that isn't of one of the nine structures proves nothing. Null histories and states are empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.operators.booking_shapes import RESULT
from millrace.operators.rules import issues
from millrace.operators.shapes import problems_of_text

CHEF = "struct<chef_id:string,chef_name:string>"
MESSAGES = "array<struct<role:string,call_id:string,content:string>>"
_RESULT = f"struct<status:string,candidates:array<{CHEF}>,alternatives:array<{CHEF}>,chef:{CHEF}>"
_CALLS, _CHEFS, _TEXTS = "array<struct<id:string,content:string>>", f"array<{CHEF}>", "array<string>"


def parsed(messages: Column) -> Column:
    """The messages with ``result``: a result's status and chefs if its structure is sound, null else. A column of its own, so that the fold doesn't parse again."""
    sound = lambda m: (m["role"] == "tool") & (F.size(problems_of_text(RESULT, m["content"])) == 0)
    return F.transform(F.coalesce(messages, F.array().cast(MESSAGES)), lambda m: F.struct(m["role"].alias("role"), m["call_id"].alias("call_id"), m["content"].alias("content"), F.when(sound(m), F.from_json(m["content"], _RESULT)).alias("result")))


def _chefs(result: Column) -> Column:
    """Candidates, else alternatives, else the one chef."""
    return F.coalesce(result["candidates"], result["alternatives"], F.when(result["chef"].isNotNull(), F.array(result["chef"])), F.array().cast(_CHEFS))


def fold(messages: Column) -> Column:
    """A struct over ``parsed`` messages.

    ``answered``: whether a result answers a call before it; ``status``, ``requested`` and ``chefs`` of the last such result, by the last call of its id before it; of all results, answering or not: ``offered`` (chefs of matched and unavailable
    ones), ``found`` (those and available ones), ``listed`` (the chefs of the last matched or unavailable one, null without)."""
    text, chefs = F.lit(None).cast("string"), F.array().cast(_CHEFS)

    def state(calls, answered, status, requested, last, offered, found, listed) -> Column:
        return F.struct(calls.cast(_CALLS).alias("calls"), answered.alias("answered"), status.alias("status"), requested.alias("requested"), last.cast(_CHEFS).alias("chefs"), offered.cast(_CHEFS).alias("offered"), found.cast(_CHEFS).alias("found"), listed.cast(_CHEFS).alias("listed"))

    def step(a: Column, m: Column) -> Column:
        r = m["result"]
        call = (m["role"] == "assistant") & m["call_id"].isNotNull()
        asked = F.filter(a["calls"], lambda c: c["id"] == m["call_id"])
        answers = r.isNotNull() & (F.size(asked) > 0)
        ours, named = _chefs(r), F.get_json_object(F.try_element_at(asked, F.lit(-1))["content"], "$.chef_name")
        lists, one = F.coalesce(r["status"].isin("matched", "unavailable"), F.lit(False)), F.coalesce(r["status"] == "available", F.lit(False))
        return state(
            F.when(call, F.array_append(a["calls"], F.struct(m["call_id"].alias("id"), m["content"].alias("content")))).otherwise(a["calls"]), a["answered"] | answers, F.when(answers, r["status"]).otherwise(a["status"]), F.when(answers, named).otherwise(a["requested"]),
            F.when(answers, ours).otherwise(a["chefs"]), F.when(lists, F.concat(a["offered"], ours)).otherwise(a["offered"]), F.when(lists | one, F.concat(a["found"], ours)).otherwise(a["found"]), F.when(lists, ours).otherwise(a["listed"]),
        )

    return F.aggregate(messages, state(F.array().cast(_CALLS), F.lit(False), text, text, chefs, chefs, chefs, F.lit(None)), step)


def _ids(chefs: Column) -> Column:
    return F.transform(chefs, lambda c: c["chef_id"])


def evidence(seen: Column, state: Column) -> Column:
    """Status, requested chef, verified ids and names (sorted) and the order of candidates, of the last answering result and the state.

    The state adds its candidates and its chef; without an answering result they also give the order, and the candidates the status."""
    offered = F.coalesce(state["candidate_chefs"], F.array().cast(_CHEFS))
    booked = state["booking_state"]
    own = F.when((booked["chef_id"] != "") & (booked["chef_name"] != ""), F.array(F.struct(booked["chef_id"].alias("chef_id"), booked["chef_name"].alias("chef_name"))))
    told = F.concat(offered, F.coalesce(own, F.array().cast(_CHEFS)))
    every = F.concat(seen["chefs"], told)
    return F.struct(
        F.when(seen["answered"], seen["status"]).when(F.size(offered) > 0, state["chef_query_status"]).alias("latest_status"), seen["requested"].alias("requested_chef"), F.array_sort(F.array_distinct(_ids(every))).alias("verified_ids"),
        F.array_sort(F.array_distinct(F.transform(every, lambda c: c["chef_name"]))).alias("verified_names"), F.when(seen["answered"], _ids(seen["chefs"])).otherwise(F.array_distinct(_ids(told))).alias("candidate_order"),
    )


def verified_set(seen: Column, state: Column) -> Column:
    """Ids that any result has found or the state holds, sorted: what an authorization may name."""
    booked = F.when(state["booking_state"]["chef_id"] != "", F.array(state["booking_state"]["chef_id"]))
    return F.array_sort(F.array_distinct(F.concat(_ids(seen["found"]), _ids(F.coalesce(state["candidate_chefs"], F.array().cast(_CHEFS))), F.coalesce(booked, F.array().cast(_TEXTS)))))


def provenance_issues(seen: Column, state: Column, chef_id: Column, said: Column) -> Column:
    """What a final answer breaks, given its chef and its candidates' ids.

    ``candidate_order``: the ids are those of the last list of chefs, or some of them, in another order; ``unknown_chef``: the chef is on no list and not among the state's candidates, where there are any."""
    lists = F.array_distinct(F.concat(_ids(seen["offered"]), _ids(F.coalesce(state["candidate_chefs"], F.array().cast(_CHEFS)))))
    listed = _ids(seen["listed"])
    moved = (F.size(listed) > 0) & (F.size(said) > 0) & (said != listed) & (F.size(F.array_except(said, listed)) == 0)
    return issues(("candidate_order", moved), ("unknown_chef", chef_id.isNotNull() & (F.size(lists) > 0) & ~F.array_contains(lists, chef_id)))


def call_differs(messages: Column, booking: Column, slots: tuple[str, ...]) -> Column:
    """The slots in which the arguments of the last call differ from a booking, as JSON values; none without a call."""
    calls = F.filter(messages, lambda m: (m["role"] == "assistant") & m["call_id"].isNotNull())
    last = F.try_element_at(calls, F.lit(-1))["content"]
    said = F.from_json(last, "map<string,string>")
    text = lambda s: F.from_json(F.to_json(F.struct(booking[s].alias(s)), {"ignoreNullFields": "false"}), "map<string,string>")[s]
    return F.when(last.isNull(), F.array().cast(_TEXTS)).otherwise(issues(*[(s, ~said[s].eqNullSafe(text(s))) for s in slots]))
