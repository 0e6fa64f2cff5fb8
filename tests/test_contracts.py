"""Contract rules on rows made by hand: nulls, ties, results without calls, and keys of all kinds."""

import json

from pyspark.sql import functions as F

from millrace.operators import contracts as c


def test_protocol_errors(spark):
    call = json.dumps({"action": "tool_call", "arguments": dict.fromkeys(("chef_name", "service_date", "start_time", "people", "address", "cuisine", "budget_min", "budget_max", "ingredient_purchase", "occasion")) | {"menu": [], "dietary_constraints": []}})
    rows = [(None, "missing_raw_text"), ("", "JSONDecodeError"), ("```", "markdown_fence"), ("null", "not_object"), ("[]", "not_object"), ("{}", "ValidationError"), ('{"action": null}', "ValidationError"), (f"\t{call}\r\n", None), (call.replace("null", "7", 1), "ValidationError"), (call[:-1], "JSONDecodeError")]
    got = spark.createDataFrame(rows, "raw string, want string").select("want", c.protocol_error(F.col("raw")).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_tool_schema(spark):
    kinds = {"a": {"type": ["string", "null"], "pattern": "x|y"}, "b": {"type": "integer"}}
    sound = {"type": "object", "additionalProperties": False, "required": ["a", "b"], "properties": kinds}
    rows = [
        (sound, None), (sound | {"required": ["b", "a"], "properties": {"b": {"type": "integer"}, "a": {"pattern": "x|y", "type": ["null", "string"]}}}, None), ({}, "type"), (sound | {"additionalProperties": None}, "additionalProperties"), (sound | {"required": ["a", "a", "b"]}, "required"),
        (sound | {"properties": kinds | {"c": {}}}, "keys"), (sound | {"properties": {}}, "keys"), (sound | {"properties": kinds | {"a": {"type": ["string", "null"], "pattern": "y|x"}}}, "definition"), (sound | {"properties": kinds | {"b": {}}}, "definition"),
    ]
    df = spark.createDataFrame([(json.dumps(s), w) for s, w in rows], "spec string, want string")
    got = df.select("want", c.tool_schema_issue(F.col("spec"), F.lit(json.dumps(sound))).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_latest_results(spark):
    call, found = lambda chef: json.dumps({"chef_name": chef}), lambda *ids: json.dumps({"status": "matched", "candidates": [{"chef_id": i} for i in ids]})
    rows = [
        (1, 1, "assistant", "x", call("n")), (1, 2, "tool", "x", found("b", "a")), (1, 3, "tool", "y", found("late")), (1, 4, "assistant", "y", call(None)),
        (2, 1, "tool", "x", found("a")), (3, 1, "assistant", "x", call(None)), (3, 2, "tool", "x", '{"status": "available", "chef": {"chef_id": "c"}}'), (3, 3, "tool", "x", '{"status": "error"}'), (4, 1, "user", None, None), (5, 1, "assistant", "x", call("zz")), (5, 2, "assistant", "x", call("aa")), (5, 3, "tool", "x", found("d")),
    ]
    df = spark.createDataFrame(rows, "conv long, pos long, role string, call_id string, content string")
    assert {tuple(r) for r in c.latest_results(df).collect()} == {(1, 2, "matched", "n", "b,a"), (3, 3, "error", None, ""), (5, 3, "matched", "aa", "d")}
    assert c.latest_results(df.limit(0)).count() == 0


def test_cases_keys_and_cards(spark):
    rows = [(1, "a", "final", "final", ["ok"], "x", None, 0), (2, "a", "final", "tool_call", [], "x", "x", 0), (3, "b", "tool_call", "tool_call", ["no", "ok"], None, None, 0)]
    df = spark.createDataFrame(rows, "id long, case_id string, output_kind string, action string, assertions array<string>, user_input string, last_user string, n_tools int")
    assert sorted(tuple(r) for r in c.case_issues(df, ("ok",)).collect()) == [(2, "duplicate_id"), (2, "output_kind"), (2, "user_said_twice"), (3, "no_tools"), (3, "unknown_assertion")]
    one = spark.range(1).select(c.allowed_keys(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), ("b", "c")).alias("m"))
    assert one.first().m == {"b": 2}
    cards = ['{"protocol_pass_rate": 0.0, "metrics": {"protocol_pass_rate": 1.0}}', '{"metrics": {"protocol_pass_rate": 0.5, "metrics": {"state_inheritance_accuracy": 0.25}}}', "{}"]
    df = spark.createDataFrame([(x,) for x in cards], "card string")
    got = [tuple(r) for r in df.select(*[c.scorecard_metrics(F.col("card"))[m] for m in ("protocol_pass_rate", "state_inheritance")]).collect()]
    assert got == [(0.0, None), (0.5, 0.25), (None, None)]


def test_lost_facts(spark):
    rows = [(["a", "b"], "x", "b a", None), (["a", "b"], "x", "b", "value"), ([None, ""], None, None, None), ([], "改成六点", "六点", "modification"), ([], "改成六点", "换六点", None), ([], "取消", "好的", "rejection"), ([], "可以", None, "confirmation"), ([], "再查", "还有没有", None)]
    df = spark.createDataFrame(rows, "v array<string>, said string, again string, want string")
    got = df.select("want", c.lost_fact(F.col("v"), F.col("said"), F.col("again")).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_trainer_format_makes_the_cases_once(spark):
    from millrace.plans import contract_queries as q

    # pairs carry what the user said; joined to the cases again, both sides of every pair would be shuffled
    assert q.dpo_trainer_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 2


def test_a_protocol_text_is_parsed_once(spark):
    # and an object isn't asked for its whole schema to be told from a list
    plan = spark.createDataFrame([("{}",)], "raw string").select(c.protocol_error(F.col("raw")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
