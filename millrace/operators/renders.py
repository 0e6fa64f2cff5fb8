"""What a training row says, derived from the facts of its scenario: search arguments, history, state, decisions, prompts.

Facts are columns: ``booking`` (the slots of a search, chef_id and confirmation), ``tool_mode``, ``tool_status`` and ``result`` (a tool's answer: candidates, alternatives, chef, requested_chef,
error_code, retryable, message; null without one), ``selected`` (the chef a user chose), ``requested_chef``, ``confirms``, ``rejects``, ``scenario``. Nothing is
written twice: every render takes its fields from the functions here, so a row can't contradict itself. All are expressions over one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.decisions import SLOTS
from millrace.operators.rules import REQUIRED, STATUS, issues
from millrace.operators.shapes import let

CHEFS = "array<struct<chef_id:string,chef_name:string>>"


def _by_status(place: int) -> Column:
    known = F.create_map(*[F.lit(x) for s in STATUS for x in (f"{s[0]}/{s[1]}", s[place])])
    return F.when(F.col("result").isNotNull(), known[F.concat("tool_mode", F.lit("/"), "tool_status")])


def query_status() -> Column:
    """What the tool's answer means; not_checked without one, or for a pair that isn't known."""
    return F.coalesce(_by_status(2), F.lit("not_checked"))


def candidates() -> Column:
    """The chefs that the tool's answer offers, in its order."""
    status, none = F.col("tool_status"), F.array().cast(CHEFS)
    one = F.when(F.col("result.chef").isNotNull(), F.array("result.chef"))
    given = F.when(status == "matched", F.col("result.candidates")).when(status == "unavailable", F.col("result.alternatives")).when(status == "available", one)
    return F.coalesce(F.when(F.col("result").isNotNull(), given), none)


def chef_id() -> Column:
    """Of the selected chef, else of the one that is available."""
    return F.when(F.col("selected").isNotNull(), F.col("selected.chef_id")).when(F.col("tool_status") == "available", F.col("result.chef.chef_id"))


def chef_name() -> Column:
    """Of the selected chef, else the requested name, else of the one that is available."""
    return F.when(F.col("selected").isNotNull(), F.col("selected.chef_name")).when(F.col("requested_chef").isNotNull(), F.col("requested_chef")).when(F.col("tool_status") == "available", F.col("result.chef.chef_name"))


def awaiting_confirmation() -> Column:
    return F.coalesce(F.col("confirms") | (F.col("tool_status") == "available"), F.col("confirms"), F.lit(False))


def confirmation() -> Column:
    """True if the user confirms, false after an error or a rejection, else open."""
    return F.when(F.col("confirms"), True).when((F.col("tool_status") == "error") | F.col("rejects"), False)


def missing_slots() -> Column:
    return issues(*[(s, F.col(f"booking.{s}").isNull()) for s in REQUIRED])


def reply_type() -> Column:
    """What is to be answered: authorization, rejection, the tool's answer, other matters, missing slots."""
    missing = missing_slots()
    return (
        F.when(F.col("confirms") & (F.col("tool_status") == "available"), "booking_authorized")
        .when(F.col("rejects"), "booking_paused")
        .when(_by_status(3).isNotNull(), _by_status(3))
        .when(F.col("scenario") == "unrelated", "handoff")
        .when(F.size(missing) == 0, "acknowledge_result")
        .when(F.size(missing) == 1, F.concat(F.lit("ask_"), F.get(missing, F.lit(0))))
        .otherwise("ask_multiple_required_fields")
    )


def query_state(result: Column) -> Column:
    """The booking as a tool's answer shows it was searched: of a search for one chef the name asked for, else that of the chef found."""
    found = F.when(result["status"] == "available", F.nullif(result["chef"]["chef_name"], F.lit("")))
    name = F.when(result["mode"] == "specific", F.coalesce(F.nullif(result["requested_chef"], F.lit("")), found))
    return F.col("booking").withField("chef_name", F.coalesce(name, F.col("booking.chef_name")))


def arguments() -> Column:
    """The twelve keys of a search, in the order of the contract."""
    lists = ("menu", "dietary_constraints")
    value = lambda s: F.coalesce(F.col(f"booking.{s}"), F.array().cast("array<string>")) if s in lists else F.col(f"booking.{s}")
    return F.struct(*[value(s).alias(s) for s in SLOTS])


def _booking() -> Column:
    return F.col("booking").withField("chef_id", F.coalesce(chef_id(), F.col("booking.chef_id"))).withField("chef_name", F.coalesce(chef_name(), F.col("booking.chef_name")))


def current_state() -> Column:
    """State before the answer: the booking with its chef, the query's status, the chefs on offer."""
    return F.struct(_booking().alias("booking_state"), query_status().alias("chef_query_status"), candidates().alias("candidate_chefs"), awaiting_confirmation().alias("awaiting_confirmation"))


def expected_final() -> Column:
    missing = missing_slots()
    fields = {
        "action": F.lit("final"), "booking_state": _booking().withField("confirmation", confirmation()), "chef_query_status": query_status(), "candidate_chefs": candidates(), "info_complete": F.size(missing) == 0,
        "unrelated": F.coalesce(F.col("scenario") == "unrelated", F.lit(False)), "missing_info": missing, "reply_type": reply_type(), "reply": F.lit(""),
    }
    return F.struct(*[v.alias(n) for n, v in fields.items()])


def expected_call() -> Column:
    return F.struct(F.lit("tool_call").alias("action"), F.lit("find_chefs").alias("tool_name"), arguments().alias("arguments"))


def _sorted(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)])
        return F.when(value.isNotNull(), fields)
    return F.transform(value, lambda x: _sorted(x, kind.elementType)) if isinstance(kind, T.ArrayType) else value


def canonical_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with struct columns as JSON with sorted keys, no blanks and nulls kept."""
    kinds = {f.name: f.dataType for f in df.select(*columns).schema}
    # bound once each, so that what a column is made of isn't repeated for each of its fields
    return df.withColumns({c: F.to_json(F.transform(F.array(c), _sorter(k))[0], {"ignoreNullFields": "false"}) for c, k in kinds.items()})


def _sorter(kind: T.DataType):
    return lambda x: _sorted(x, kind)


def _spaced(value: Column, kind: T.DataType) -> Column:
    """JSON with a blank after commas and colons, keys in their order."""
    if isinstance(kind, T.StructType):
        each = [F.concat(F.lit(f'"{f.name}": '), _spaced(value[f.name], f.dataType)) for f in kind]
        return F.when(value.isNull(), "null").otherwise(F.concat(F.lit("{"), F.array_join(F.array(*each), ", "), F.lit("}")))
    if isinstance(kind, T.ArrayType):
        return F.when(value.isNull(), "null").otherwise(F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _spaced(x, kind.elementType)), ", "), F.lit("]")))
    return let(F.to_json(F.array(value)), lambda text: F.substr(text, F.lit(2), F.length(text) - 2))


def spaced_json(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a struct column as the JSON that plain writers make."""
    kind = df.schema[column].dataType
    return df.withColumn(column, F.transform(F.array(column), lambda x: _spaced(x, kind))[0])


def history(call_id: Column, said: Column, arguments_text: Column, result_text: Column) -> Column:
    """Three messages as canonical JSON: what the user said, the call with its arguments, the tool's answer."""
    j = lambda **fields: F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    call = F.struct(F.struct(arguments_text.alias("arguments"), F.lit("find_chefs").alias("name")).alias("function"), call_id.alias("id"), F.lit("function").alias("type"))
    return F.array(
        j(role=F.lit("user"), content=said), j(role=F.lit("assistant"), content=F.lit(None).cast("string"), tool_calls=F.array(call)),
        j(role=F.lit("tool"), tool_call_id=call_id, name=F.lit("find_chefs"), content=result_text),
    )


def prompt(contract: Column, rules: Column, time: Column, state: Column, tools: Column, past: Column, said: Column) -> Column:
    """The messages of a prompt, each as canonical JSON: a system message that holds the contract, rules, time, state and tools, then the past ones, then what the user says, if anything.

    ``contract``, ``state`` and ``tools`` are canonical JSON themselves, ``past`` an array of such messages (null: none)."""
    quoted = lambda c: let(F.to_json(F.array(c)), lambda text: F.substr(text, F.lit(2), F.length(text) - 2))
    body = F.concat(F.lit('{"available_tools":'), tools, F.lit(',"current_state":'), state, F.lit(',"current_time":'), quoted(time), F.lit(',"output_contract":'), contract, F.lit(',"rules":'), quoted(rules), F.lit("}"))
    message = lambda role, text: F.to_json(F.struct(text.alias("content"), F.lit(role).alias("role")))
    now = F.when(said.isNotNull(), F.array(message("user", said))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(message("system", body)), F.coalesce(past, F.array().cast("array<string>")), now)


def with_block(messages: Column, block: str) -> Column:
    """The messages with a block of text added to the content of the first system message."""
    put = lambda m: F.to_json(F.struct(F.concat(F.get_json_object(m, "$.content"), F.lit(block)).alias("content"), F.lit("system").alias("role")))
    # the messages, and the place of the first, are found once, not once more for each message
    place = lambda all_: F.array_position(F.transform(all_, lambda m: F.get_json_object(m, "$.role")), "system")
    return let(messages, lambda all_: let(place(all_), lambda first: F.transform(all_, lambda m, i: F.when(i + 1 == first, put(m)).otherwise(m))))


def to_text(messages: Column) -> Column:
    """A line for each message."""
    return F.array_join(messages, "\n")
