"""Shapes against a plain recursive check, and the checked reader on files of many splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import leaves
from millrace.operators import booking_shapes as b
from millrace.operators import shapes as s
from millrace.sources import checked


def kind_of(v):
    return "null" if v is None else "flag" if isinstance(v, bool) else "whole" if isinstance(v, int) else "number" if isinstance(v, float) else "text" if isinstance(v, str) else "list" if isinstance(v, list) else "object"


def plain(shape, v, at="$"):
    """The problems of a parsed value, by recursion."""
    have = kind_of(v)
    if isinstance(shape, s.Nullable):
        return [] if have == "null" else plain(shape.of, v, at)
    want = {s.Record: "object", s.Union: "object", s.Having: "object", s.Items: "list", s.Inside: "text"}.get(type(shape)) or shape.kind
    if want == "null":
        return [] if have == "null" else [(at, "type")]
    if have == "null":
        return [(at, "null")]
    if have != want and not (want == "number" and have == "whole"):
        return [(at, "type")]
    if isinstance(shape, s.Leaf):
        import datetime
        import re

        bad = (shape.values and v not in shape.values) or (shape.pattern and not re.search(shape.pattern, v))
        if shape.day:
            try:
                bad = not re.fullmatch(r"\d{4}-\d{2}-\d{2}", v) or datetime.date.fromisoformat(v) is None
            except ValueError:
                bad = True
        return [(at, "value")] if bad else []
    if isinstance(shape, s.Record):
        out = [x for k, f in shape.fields.items() for x in (plain(f, v[k], f"{at}.{k}") if k in v else [] if k in shape.optional else [(f"{at}.{k}", "missing")])]
        return out + [(f"{at}.{k}", "extra") for k in sorted(v) if k not in shape.fields and not shape.open]
    if isinstance(shape, s.Items):
        ends = [(at, "few")] * (len(v) < shape.least) + [(at, "many")] * (shape.most is not None and len(v) > shape.most)
        return ends + [x for i, item in enumerate(v) for x in plain(shape.of, item, f"{at}[{i}]")]
    if isinstance(shape, s.Union):
        variant = shape.variants.get(tuple(v.get(t) if isinstance(v.get(t), str) else None for t in shape.tags))
        return plain(variant, v, at) if variant else [(at, "tag")]
    if isinstance(shape, s.Having):
        return plain(shape.then if v.get(shape.key) else shape.otherwise, v, at)
    try:
        return plain(shape.of, json.loads(v), at)
    except ValueError:
        return [(at, "json")]


ARGS = dict.fromkeys(("chef_name", "service_date", "start_time", "people", "address", "cuisine", "budget_min", "budget_max", "ingredient_purchase", "occasion")) | {"menu": ["a"], "dietary_constraints": []}
CHEF = {"chef_id": "c", "chef_name": "n"}
FINAL = {"action": "final", "booking_state": ARGS | {"chef_id": "c", "confirmation": True, "people": 4, "service_date": "2026-08-14", "start_time": "18:30", "budget_min": 1.5}, "chef_query_status": "matched", "candidate_chefs": [CHEF, CHEF], "info_complete": True, "unrelated": False, "missing_info": [], "reply_type": "handoff", "reply": None}
CALL = {"action": "tool_call", "tool_name": "find_chefs", "arguments": ARGS}
RESULTS = [
    {"mode": "search", "status": "matched", "candidates": [CHEF]}, {"mode": "search", "status": "no_match", "candidates": []}, {"mode": "search", "status": "out_of_service_area", "candidates": []}, {"mode": "search", "status": "error", "error_code": "E", "retryable": True, "message": "m"},
    {"mode": "specific", "status": "available", "chef": CHEF}, {"mode": "specific", "status": "unavailable", "requested_chef": "x", "alternatives": [CHEF]}, {"mode": "specific", "status": "unavailable", "requested_chef": "x", "alternatives": []}, {"mode": "specific", "status": "not_found", "requested_chef": "x", "alternatives": []},
    {"mode": "specific", "status": "out_of_service_area", "requested_chef": "x", "alternatives": []}, {"mode": "specific", "status": "error", "error_code": "E", "retryable": False, "message": "m"},
]
ASKS = {"role": "assistant", "content": None, "tool_calls": [{"id": "1", "type": "function", "function": {"name": "find_chefs", "arguments": json.dumps(ARGS)}}]}
MESSAGES = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}, ASKS, {"role": "tool", "tool_call_id": "1", "name": "find_chefs", "content": json.dumps(RESULTS[0])}]
ODD = (None, True, 3, 3.0, 2.5, 10**20, "x", "", "2026-02-30", "24:00", [], [1, None], {}, {"a": 1}, "{", "[]")


def spoilt(rng, v):
    """A copy with one place changed: a value replaced, a key dropped, added or renamed, an item repeated."""
    v = json.loads(json.dumps(v))
    places = []

    def walk(x):
        for k in x if isinstance(x, dict) else range(len(x)) if isinstance(x, list) else ():
            places.append((x, k))
            walk(x[k])

    walk(v)
    if not places:
        return rng.choice(ODD)
    x, k = rng.choice(places)
    how = rng.randrange(5)
    if how == 0 and isinstance(x, dict):
        del x[k]
    elif how == 1 and isinstance(x, dict):
        x[f"z{k}"] = 1
    elif how == 2 and isinstance(x, list):
        x.append(x[k])
    else:
        x[k] = rng.choice(ODD)
    return v


@pytest.mark.parametrize(("shape", "sound"), [(b.DECISION, [FINAL, CALL]), (b.RESULT, RESULTS), (b.MESSAGE, MESSAGES), (b.WHOLE_MESSAGE, MESSAGES)], ids=["decision", "result", "message", "whole_message"])
def test_shapes_as_by_recursion(spark, shape, sound):
    rng = random.Random(5)
    values = [*sound, *ODD, *[spoilt(rng, rng.choice(sound)) for _ in range(250)]]
    values += [spoilt(rng, spoilt(rng, rng.choice(sound))) for _ in range(50)]
    assert not any(plain(shape, v) for v in sound)
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    got = {r.i: sorted(map(tuple, r.p)) for r in spark.createDataFrame(rows, "i long, t string").select("i", s.problems_of_text(shape, F.col("t")).alias("p")).collect()}
    want = {i: sorted(plain(shape, v)) for i, v in enumerate(values)}
    assert {i: (values[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert {x for p in want.values() for _, x in p} >= {"type", "missing", "extra", "tag"}


def test_whole_samples(spark):
    shape = b.sample("contract-1")
    state = {"booking_state": {}, "awaiting_confirmation": False}
    given = {"history": MESSAGES, "current_state": state, "user_input": None, "current_time": "2026-08-12 09:00", "available_tools": [{"type": "function", "function": {"name": "find_chefs", "description": "d", "parameters": {"any": 1}}}]}
    sample = {"id": "a", "dataset_version": "v", "scenario": "s", "output_kind": "final", "conversation_kind": "multi_turn", "input": given, "expected": FINAL, "generation": {"prompt_sha256": "0" * 64, "generated_at": "t", "relative_time_metadata": None}, "dpo_targets": ["H1", "H9"]}
    rng = random.Random(6)
    values = [sample, sample | {"dpo_targets": ["H10"]}, sample | {"contract_id": "x"}, sample | {"contract_id": "contract-1"}, *[spoilt(rng, sample) for _ in range(60)]]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i long, t string").select("i", s.problems_of_text(shape, F.col("t")).alias("p")).collect()
    assert {r.i: sorted(map(tuple, r.p)) for r in rows} == {i: sorted(plain(shape, v)) for i, v in enumerate(values)}


def test_texts_that_are_no_json(spark):
    rows = [(i, t) for i, t in enumerate((None, "", " ", "{", "nope", '{"a": 1, "a": 2}'))]
    got = spark.createDataFrame(rows, "i long, t string").select(s.problems_of_text(b.RESULT, F.col("t")).alias("p")).collect()
    assert all([tuple(x) for x in r.p] == [("$", "json")] for r in got)


LINE = s.Record({"id": s.TEXT, "n": s.WHOLE})


@pytest.fixture
def files(tmp_path):
    rng = random.Random(7)
    want, blank = {}, 0
    for name in ("one.jsonl", "two.jsonl"):
        lines = []
        for i in range(4000):
            how = rng.randrange(40)
            if how == 0:
                lines.append(rng.choice(("", "  ", "\t", "　")))
                blank += 1
            elif how == 1:
                lines.append('{"id": "cut"')
                want[name, len(lines)] = [("$", "json")]
            elif how == 2:
                lines.append(json.dumps({"id": f"{name}-{i}", "n": "3"}))
                want[name, len(lines)] = [("$.n", "type")]
            elif how == 3 and lines:
                lines.append(json.dumps({"id": f"{name}-0" if name == "one.jsonl" else "one.jsonl-0", "n": i}))
                want[name, len(lines)] = [("$.id", "duplicate")]
            else:
                lines.append(json.dumps({"id": f"{name}-{i}", "n": i}))
        lines[0] = json.dumps({"id": f"{name}-0", "n": 0})
        want.pop((name, 1), None)
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "one.jsonl" else ""))
    (tmp_path / "three.jsonl").write_text("")
    return str(tmp_path), want


def test_faults_by_file_and_line(spark, files):
    path, want = files
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9001")
    try:
        rows = checked.with_duplicates(checked.read_checked(spark, path, LINE), "id")
        assert checked.numbered_lines(spark, path).rdd.getNumPartitions() > 1
        got = {}
        for r in checked.faults(rows).collect():
            got.setdefault((r.file.rpartition("/")[2], r.line), []).append((r.path, r.issue))
        assert got == want
        lines = checked.numbered_lines(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("line").alias("d"), F.min("line").alias("a"), F.max("line").alias("b")).collect()
        assert sorted((r.n, r.d, r.a, r.b) for r in lines) == [(4000, 4000, 1, 4000)] * 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_loading_stops_at_faults(spark, files, tmp_path_factory):
    with pytest.raises(checked.Faulty, match=r"\d+ faults, the first of them one.jsonl:\d+: "):
        checked.load_valid(spark, files[0], LINE, "id string, n long", key="id")
    good = tmp_path_factory.mktemp("good") / "a.jsonl"
    good.write_text('{"id": "a", "n": 1}\r\n\r\n{"n": 2, "id": "b"}\r\n')
    assert sorted(map(tuple, checked.load_valid(spark, str(good), LINE, "id string, n long", key="id").collect())) == [("a", 1), ("b", 2)]
    assert checked.load_valid(spark, f"{files[0]}/three.jsonl", LINE, "id string").count() == 0


def test_string_leaves(spark):
    deep = "x"
    for i in range(300):
        deep = {"k": [deep, i]} if i % 2 else [deep, {"z": f"t{i}"}]
    rng = random.Random(8)
    texts = [None, "", "nope", "3", '"one"', '{"b": "2", "a": "1", "b": "3"}', '[" a ", "", null, true, {"k": {}}]', json.dumps(deep), *[json.dumps(spoilt(rng, rng.choice([FINAL, CALL, *MESSAGES])), ensure_ascii=False) for _ in range(40)]]

    def collect(v):
        if isinstance(v, str):
            yield v
        for x in v if isinstance(v, list) else v.values() if isinstance(v, dict) else ():
            yield from collect(x)

    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(leaves.string_leaves(F.col("t")).alias("x")).collect()]
    assert got[:7] == [[], [], [], [], ["one"], ["2", "1", "3"], [" a ", ""]]
    assert got[7:] == [list(collect(json.loads(t))) for t in texts[7:]]
    assert spark.range(1).select(leaves.calibration_line(F.lit(texts[6])).alias("x")).first().x == "a"


def test_objects_are_not_asked_for_their_schema(spark):
    # the schema of a scalar only: that of an object costs as much as reading all of it, at every level again
    plan = spark.range(1).select(s.problems_of_text(b.DECISION, F.lit("{}")).alias("p"))._jdf.queryExecution().logical().toString().lower()
    assert "^object" not in plan and "^array" not in plan
    deep = '{"action":"tool_call","arguments":' * 3 + "null" + "}" * 3
    assert [tuple(p) for p in spark.range(1).select(s.problems_of_text(b.DECISION, F.lit(deep)).alias("p")).first().p][-1] == ("$.arguments.arguments", "extra")


def test_spoilt_texts_meet_constant_patterns_only(spark):
    from millrace.plans import structure_queries as q

    changes = ((2, 0, "a", "b"), (3, 0, "^(.)", "<\\1>"))
    out = spark.range(7).select(q._spoilt(F.when(F.col("id") != 1, "aha"), F.col("id"), changes).alias("t"))
    assert [r.t for r in out.collect()] == ["<b>hb", None, "bhb", "<a>ha", "bhb", "aha", "<b>hb"]
    assert "(?!)" not in out._jdf.queryExecution().logical().toString()


def test_records_are_spread_over_tasks(spark):
    from millrace.plans.rule_queries import records

    plan = records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
