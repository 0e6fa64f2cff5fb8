"""Queries that hold JSON against shapes: lines of files, messages of histories, tool results and decisions, made from whole tables and spoilt in their text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import booking_shapes as b
from millrace.operators import contracts, preflight, shapes
from millrace.operators.rules import missing_slots, with_tool_status
from millrace.operators.shapes import TEXT, WHOLE, Nullable, Record, one_of
from millrace.plans.rule_queries import _RECORDS, records
from millrace.plans.shape_sql import problems_of_text_sql
from millrace.shared import new_path
from millrace.sources import checked
from millrace.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]), {"ignoreNullFields": "false"})


#: How texts are spoilt: those of which the number leaves rest r on division by m have a pattern replaced (in SQL's notation of groups), or lose their last character.
def _spoilt(text: Column, number: Column, changes) -> Column:
    for change in changes:  # only texts that are changed meet a pattern, and each text is computed once
        text = shapes.let(text, _changed(number, *change))
    return text


def _changed(number: Column, m: int, r: int, pattern: str, to: str):
    return lambda t: F.when(number % m == r, F.regexp_replace(t, F.lit(pattern), F.lit(to.replace("\\1", "$1")))).otherwise(t)


def _spoilt_sql(text: str, number: str, changes) -> str:
    for m, r, pattern, to in changes:
        text = f"CASE WHEN {number} % {m} = {r} THEN regexp_replace({text}, '{pattern}', '{to}', 'g') ELSE {text} END"
    return text


#: Lines of a file of turns.
LINE = Record({"id": TEXT, "turn": WHOLE, "role": one_of("system", "user", "assistant"), "content": Nullable(TEXT)})
_LINE_CHANGES = ((11, 0, "}$", ""), (13, 1, '"role"', '"rule"'), (17, 2, '"turn":([0-9]+)', '"turn":"\\1"'), (19, 3, '"role":"user"', '"role":"bot"'), (23, 4, '"id":"c[0-9]+-', '"id":"c-'))
_N = "conv_id * 31 + turn"


@query(f"""WITH l AS (SELECT conv_id // 50 AS part, conv_id, turn, {_N} AS n, to_json({{'id': 'c' || conv_id || '-' || turn, 'turn': turn, 'role': role, 'content': text}})::VARCHAR AS t FROM conversations),
s AS (SELECT part, n, {_spoilt_sql('t', 'n', _LINE_CHANGES)} AS t, sum(CASE WHEN n % 29 = 5 THEN 2 ELSE 1 END) OVER (PARTITION BY part ORDER BY conv_id, turn) AS line FROM l),
k AS (SELECT *, CASE WHEN json_valid(t) THEN json_extract_string(t, '$.id') END AS id FROM s), d AS (SELECT *, id IS NOT NULL AND row_number() OVER (PARTITION BY id ORDER BY CAST(part AS VARCHAR), line) > 1 AS again FROM k),
p AS (SELECT part, line, unnest(list_concat({problems_of_text_sql(LINE, 't')}, CASE WHEN again THEN [{{'path': '$.id', 'issue': 'duplicate'}}] ELSE [] END)) AS p FROM d)
SELECT CAST(part AS BIGINT) AS part, CAST(line AS BIGINT) AS line, p.path AS path, p.issue AS issue FROM p""")
def checked_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every fault of a line-delimited copy of the conversations, by file and line: spoilt lines, blank lines between, ids that repeat."""
    t = table(spark, sf, "conversations").withColumns({"part": F.expr("conv_id div 50"), "n": F.expr(_N)})
    line = _json(id=F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")), turn=F.col("turn"), role=F.col("role"), content=F.col("text"))
    line = _spoilt(line, F.col("n"), _LINE_CHANGES)
    lines = t.withColumn("value", F.when(F.col("n") % 29 == 5, F.concat(F.lit(" \n"), line)).otherwise(line))
    path = new_path(spark, "turns")
    # a file holds the turns of fifty conversations, so files grow in number, not in size
    lines.repartition("part").sortWithinPartitions("part", "conv_id", "turn").select("part", "value").write.partitionBy("part").text(path)
    rows = checked.with_duplicates(checked.read_checked(spark, f"{path}/*/*.txt", LINE), "id")
    return checked.faults(rows).select(F.regexp_extract("file", r"part=(\d+)/", 1).cast("long").alias("part"), "line", "path", "issue")


_CHEF = "{'chef_id': 'chef_' || x, 'chef_name': 'name-' || x}"
_RESULT_CHANGES = ((11, 0, '"mode"', '"kind"'), (13, 1, '"chef_name":"([a-z0-9-]+)"', '"chef_name":7'), (17, 2, '"status":"([a-z_]+)"', '"status":"odd"'), (19, 3, '"candidates":', '"people":3,"candidates":'), (23, 4, "}$", ""), (7, 5, '"retryable":false', '"retryable":"no"'))
_RESULT_SQL = f"""CASE WHEN status = 'odd' THEN to_json({{'mode': mode, 'status': 'error', 'error_code': 'E1', 'retryable': false, 'message': 'odd'}}) WHEN mode = 'search' AND status = 'error' THEN to_json({{'mode': mode, 'status': status, 'error_code': 'E2', 'retryable': true}})
 WHEN mode = 'search' THEN to_json({{'mode': mode, 'status': status, 'candidates': list_transform(tool_ids, lambda x: {_CHEF})}}) WHEN status = 'available' AND len(tool_ids) > 0 THEN to_json({{'mode': mode, 'status': status, 'chef': list_transform(tool_ids, lambda x: {_CHEF})[1]}})
 WHEN status = 'available' THEN to_json({{'mode': mode, 'status': status, 'chef': NULL}}) ELSE to_json({{'mode': mode, 'status': status, 'requested_chef': 'n', 'alternatives': list_transform(tool_ids, lambda x: {_CHEF})}}) END"""


def tool_results(spark: SparkSession, sf: str) -> DataFrame:
    """A tool result (id, customer, content) as JSON for each order, in all variants, sound or spoilt."""
    mode, status = F.col("mode"), F.col("status")
    chefs = F.transform("tool_ids", lambda x: F.struct(F.concat(F.lit("chef_"), x.cast("string")).alias("chef_id"), F.concat(F.lit("name-"), x.cast("string")).alias("chef_name")))
    text = (
        F.when(status == "odd", _json(mode=mode, status=F.lit("error"), error_code=F.lit("E1"), retryable=F.lit(False), message=F.lit("odd")))
        .when((mode == "search") & (status == "error"), _json(mode=mode, status=status, error_code=F.lit("E2"), retryable=F.lit(True)))
        .when(mode == "search", _json(mode=mode, status=status, candidates=chefs))
        .when(status == "available", _json(mode=mode, status=status, chef=F.get(chefs, F.lit(0))))
        .otherwise(_json(mode=mode, status=status, requested_chef=F.lit("n"), alternatives=chefs))
    )
    return records(spark, sf).select("id", "cust", "mode", "status", _spoilt(text, F.col("id"), _RESULT_CHANGES).alias("content"))


@query(_RECORDS + f""", t AS (SELECT id, {_RESULT_SQL}::VARCHAR AS t FROM r), s AS (SELECT id, {_spoilt_sql('t', 'id', _RESULT_CHANGES)} AS t FROM t),
p AS (SELECT id, unnest({problems_of_text_sql(b.RESULT, 't')}) AS p FROM s) SELECT id, p.path AS path, p.issue AS issue FROM p""")
def tool_result_structure(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the structure of each tool result: of nine variants by mode and status."""
    return tool_results(spark, sf).select("id", F.explode(shapes.problems_of_text(b.RESULT, F.col("content"))).alias("p")).select("id", "p.path", "p.issue")


_DECISION_CHANGES = (
    (11, 0, '"people":([0-9]+)', '"people":"\\1"'), (13, 1, '"action":"([a-z_]+)"', '"action":"odd"'), (17, 2, "}$", ""), (19, 3, '"info_complete":(true|false)', '"info_complete":null'), (23, 4, '"menu":', '"menus":'), (29, 5, '"start_time":"([0-9:]+)"', '"start_time":"24:00"'),
    (31, 6, '"service_date":"([0-9]+)-([0-9-]+)"', '"service_date":"\\1-02-30"'), (37, 7, '"reply_type":"([a-z_]+)"', '"reply_type":"none"'), (41, 8, '"chef_name":"([a-z0-9-]+)"', '"chef_name":{}'), (43, 9, '"missing_info":', '"missing_info":[],"more":'),
)
_ARGS_SQL = "'chef_name': NULL, 'service_date': service_date, 'start_time': start_time, 'people': people, 'address': address, 'cuisine': NULL, 'budget_min': 100.5, 'budget_max': NULL, 'menu': CASE WHEN id % 2 = 0 THEN ['fish'] ELSE [] END, 'ingredient_purchase': confirms, 'dietary_constraints': diet, 'occasion': NULL"
_DECISION_SQL = f"""CASE WHEN id % 4 = 1 THEN to_json({{'action': 'tool_call', 'tool_name': 'find_chefs', 'arguments': {{{_ARGS_SQL}}}}})
 ELSE to_json({{'action': 'final', 'booking_state': {{{_ARGS_SQL}, 'chef_id': 'chef_' || chef_id, 'confirmation': confirms}}, 'chef_query_status': coalesce(query_status, 'not_checked'), 'candidate_chefs': list_transform(tool_ids, lambda x: {_CHEF}), 'info_complete': len(missing) = 0,
 'unrelated': unrelated, 'missing_info': missing, 'reply_type': CASE WHEN unrelated THEN 'handoff' ELSE 'acknowledge_result' END, 'reply': CASE WHEN id % 3 = 0 THEN 'ok' END}}) END"""


def decision_texts(spark: SparkSession, sf: str, dealt: Callable[[DataFrame], DataFrame] = lambda orders: orders) -> DataFrame:
    """A decision (id, answer) as JSON by the contract for each order, sound or spoilt; ``dealt`` as in ``records``."""
    k, c = F.col("id"), F.col
    null = F.lit(None).cast("string")
    args = {
        "chef_name": null, "service_date": c("service_date"), "start_time": c("start_time"), "people": c("people"), "address": c("address"), "cuisine": null, "budget_min": F.lit(100.5), "budget_max": F.lit(None).cast("double"),
        "menu": F.when(k % 2 == 0, F.array(F.lit("fish"))).otherwise(F.array().cast("array<string>")), "ingredient_purchase": c("confirms"), "dietary_constraints": c("diet"), "occasion": null,
    }
    struct = lambda fields: F.struct(*[v.alias(n) for n, v in fields.items()])
    chefs = F.transform("tool_ids", lambda x: F.struct(F.concat(F.lit("chef_"), x.cast("string")).alias("chef_id"), F.concat(F.lit("name-"), x.cast("string")).alias("chef_name")))
    r = with_tool_status(records(spark, sf, dealt)).withColumn("missing", missing_slots())
    call = _json(action=F.lit("tool_call"), tool_name=F.lit("find_chefs"), arguments=struct(args))
    state = struct(args | {"chef_id": F.concat(F.lit("chef_"), c("chef_id").cast("string")), "confirmation": c("confirms")})
    final = _json(action=F.lit("final"), booking_state=state, chef_query_status=c("query_status"), candidate_chefs=chefs, info_complete=F.size("missing") == 0, unrelated=c("unrelated"), missing_info=c("missing"),
                  reply_type=F.when(c("unrelated"), "handoff").otherwise("acknowledge_result"), reply=F.when(k % 3 == 0, "ok"))
    return r.select("id", _spoilt(F.when(k % 4 == 1, call).otherwise(final), k, _DECISION_CHANGES).alias("answer"))


_DECISIONS = _RECORDS + f", t AS (SELECT id, {_DECISION_SQL}::VARCHAR AS t FROM r LEFT JOIN st USING (mode, status)), s AS (SELECT id, {_spoilt_sql('t', 'id', _DECISION_CHANGES)} AS t FROM t)"


@query(_DECISIONS + f", p AS (SELECT id, unnest({problems_of_text_sql(b.DECISION, 't')}) AS p FROM s) SELECT id, p.path AS path, p.issue AS issue FROM p")
def decision_structure(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the structure of each decision: the call or the answer, every key, type, date and constant."""
    return decision_texts(spark, sf).select("id", F.explode(shapes.problems_of_text(b.DECISION, F.col("answer"))).alias("p")).select("id", "p.path", "p.issue")


#: Answers as models give them: fenced, wrapped in a list, with white space around, or none.
_ANSWER_CHANGES = ((53, 1, "^", "```json"), (59, 2, "$", " ```"), (61, 3, "^", "  "), (67, 4, "^(.*)$", "[\\1]"), (71, 5, "^.*$", "sorry"))


@query(_DECISIONS + f""", a AS (SELECT id, CASE WHEN id % 47 <> 0 THEN {_spoilt_sql('t', 'id', _ANSWER_CHANGES)} END AS raw FROM s), t AS (SELECT *, trim(raw) AS t FROM a)
SELECT id, CASE WHEN raw IS NULL THEN 'missing_raw_text' WHEN starts_with(t, '```') OR ends_with(t, '```') THEN 'markdown_fence' WHEN NOT json_valid(t) THEN 'JSONDecodeError' WHEN json_type(CAST(t AS JSON)) <> 'OBJECT' THEN 'not_object'
 WHEN len({problems_of_text_sql(b.DECISION, 't')}) > 0 THEN 'ValidationError' END AS error FROM t""".replace(", t AS (SELECT *, trim", ", tr AS (SELECT *, trim").replace("END AS error FROM t", "END AS error FROM tr"))
def protocol_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Why each answer isn't a decision; null where it is."""
    raw = F.when(F.col("id") % 47 != 0, _spoilt(F.col("answer"), F.col("id"), _ANSWER_CHANGES))
    return decision_texts(spark, sf).withColumn("raw", raw).select("id", contracts.protocol_error(F.col("raw")).alias("error"))


_MESSAGE_CHANGES = ((11, 0, '"role":"user"', '"role":"guest"'), (13, 1, '"content":null', '"content":"x"'), (17, 2, '"name":"find_chefs"', '"name":"find"'), (19, 3, '"tool_calls":.*}]}$', '"tool_calls":[]}'), (23, 4, '"content":"', '"extra":1,"content":"'), (29, 5, '"tool_call_id":"([a-z0-9]+)"', '"tool_call_id":null'))


@query(_DECISIONS.replace(", s AS (", ", sp AS (") + f""", res AS (SELECT id, {_RESULT_SQL}::VARCHAR AS t FROM r), rs AS (SELECT id, {_spoilt_sql('t', 'id', _RESULT_CHANGES)} AS t FROM res),
calls AS (SELECT id * 2 AS n, to_json({{'role': 'assistant', 'content': NULL, 'tool_calls': [{{'id': 'c' || id, 'type': 'function', 'function': {{'name': 'find_chefs', 'arguments': CASE WHEN id % 4 = 1 AND json_valid(t) THEN CAST(CAST(t AS JSON) -> '$.arguments' AS VARCHAR) ELSE t END}}}}]}})::VARCHAR AS t FROM sp),
m AS (SELECT 'call' AS kind, n, t FROM calls UNION ALL SELECT 'result', id * 2 + 1, to_json({{'role': 'tool', 'tool_call_id': 'c' || id, 'name': 'find_chefs', 'content': t}})::VARCHAR FROM rs
 UNION ALL SELECT 'turn', conv_id * 100 + turn, to_json({{'role': role, 'content': text}})::VARCHAR FROM conversations),
s AS (SELECT kind, n, {_spoilt_sql('t', 'n', _MESSAGE_CHANGES)} AS t FROM m),
p AS (SELECT kind, n, unnest({problems_of_text_sql(b.WHOLE_MESSAGE, 't')}) AS p FROM s) SELECT kind, n, p.path AS path, p.issue AS issue FROM p""")
def message_structure(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with each message: turns of conversations, calls with their arguments, and results with their content."""
    answer = F.col("answer")
    args = F.when((F.col("id") % 4 == 1) & F.try_parse_json(answer).isNotNull(), F.get_json_object(answer, "$.arguments")).otherwise(answer)
    name = F.concat(F.lit("c"), F.col("id").cast("string"))
    call = F.struct(name.alias("id"), F.lit("function").alias("type"), F.struct(F.lit("find_chefs").alias("name"), args.alias("arguments")).alias("function"))
    calls = decision_texts(spark, sf).select(F.lit("call").alias("kind"), (F.col("id") * 2).alias("n"), _json(role=F.lit("assistant"), content=F.lit(None).cast("string"), tool_calls=F.array(call)).alias("t"))
    results = tool_results(spark, sf).select(F.lit("result"), F.col("id") * 2 + 1, _json(role=F.lit("tool"), tool_call_id=name, name=F.lit("find_chefs"), content=F.col("content")))
    turns = table(spark, sf, "conversations").select(F.lit("turn"), F.col("conv_id") * 100 + F.col("turn"), _json(role=F.col("role"), content=F.col("text")))
    spoilt = calls.union(results).union(turns).withColumn("t", _spoilt(F.col("t"), F.col("n"), _MESSAGE_CHANGES))
    return spoilt.select("kind", "n", F.explode(shapes.problems_of_text(b.WHOLE_MESSAGE, F.col("t"))).alias("p")).select("kind", "n", "p.path", "p.issue")


_DPO_CHANGES = ((11, 0, '"heuristic":"H1"', '"heuristic":null'), (13, 1, '"chosen_sha256":"[0-9a-f]{4}', '"chosen_sha256":"'), (17, 2, '"rejected_sha256":"[0-9a-f]{4}', '"rejected_sha256":"0000'), (19, 3, '"id":"dpo', '"id":"dpo-FROZEN'), (23, 4, '}$', ''), (29, 5, '"tags":', '"more":1,"tags":'), (31, 6, '"id":"dpo-[0-9]+', '"id":"dpo-1'))
_DPO_SQL = _DECISIONS.replace(", s AS (", ", sp AS (") + f""", l0 AS (SELECT id, to_json({{'id': 'dpo-' || id || '-H1', 'raw_id': 'r' || id, 'dataset_version': 'v', 'heuristic': 'H1', 'prompt': [{{'role': 'user', 'content': 'hi'}}], 'chosen': t, 'rejected': t || ' ', 'chosen_sha256': sha256(t), 'rejected_sha256': sha256(t || ' '), 'tags': ['a']}})::VARCHAR AS t FROM sp),
s AS (SELECT id, {_spoilt_sql('t', 'id', _DPO_CHANGES)} AS t FROM l0), k AS (SELECT *, {problems_of_text_sql(b.DPO_ROW, 't')} AS p, CASE WHEN json_valid(t) THEN json_extract_string(t, '$.id') END AS name FROM s),
d AS (SELECT *, name IS NOT NULL AND row_number() OVER (PARTITION BY name ORDER BY lpad(CAST(id // 500 AS VARCHAR), 9, '0'), id) > 1 AS again FROM k), c AS (SELECT *, len(p) = 0 AS sound FROM d),
f AS (SELECT id, sound, list_concat(list_concat(list_concat(p, CASE WHEN sound AND regexp_matches(lower(name), 'frozen|diagnostic|missing_mock_prediction|phase02|base_benchmark') THEN [{{'path': '$.id', 'issue': 'forbidden'}}] ELSE [] END),
 CASE WHEN sound AND NOT regexp_matches(lower(name), 'frozen|diagnostic|missing_mock_prediction|phase02|base_benchmark') AND sha256(t ->> '$.rejected') <> (t ->> '$.rejected_sha256') THEN [{{'path': '$.rejected_sha256', 'issue': 'digest'}}] ELSE [] END), CASE WHEN again THEN [{{'path': '$.id', 'issue': 'duplicate'}}] ELSE [] END) AS p FROM c)
"""


#: Orders whose pairs share a file, some 40 MB of it, a tenth on disk: files of any number of orders, by the order of ids, have their lines in one order.
_PART = 25_000


def _dpo_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line-delimited files of preference pairs of all orders, sound or spoilt, checked, with the places of their lines."""
    # lines are made where they are written: orders are dealt to files while they are narrow, a file's orders to one task, and files are compressed
    n_tasks = max(1, -(-table(spark, sf, "orders").count() // _PART))
    answers = decision_texts(spark, sf, lambda orders: orders.repartitionById(n_tasks, F.expr(f"CAST(pmod(o_orderkey div {_PART}, {n_tasks}) AS INT)")))
    answers = answers.withColumn("part", F.lpad(F.expr(f"id div {_PART}").cast("string"), 9, "0")).sortWithinPartitions("part", "id")
    a, k = F.col("answer"), F.col("id").cast("string")
    other = F.concat(a, F.lit(" "))
    line = _json(id=F.concat(F.lit("dpo-"), k, F.lit("-H1")), raw_id=F.concat(F.lit("r"), k), dataset_version=F.lit("v"), heuristic=F.lit("H1"), prompt=F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))),
                 chosen=a, rejected=other, chosen_sha256=F.sha2(a, 256), rejected_sha256=F.sha2(other, 256), tags=F.array(F.lit("a")))
    path = new_path(spark, "pairs")
    answers.select("part", _spoilt(line, F.col("id"), _DPO_CHANGES).alias("value")).write.partitionBy("part").option("compression", "gzip").text(path)
    rows = preflight.forbid_ids(checked.read_placed(spark, path, b.DPO_ROW))
    return preflight.check_digests(rows, {"chosen_sha256": "chosen", "rejected_sha256": "rejected"})


@query(_DPO_SQL + ", u AS (SELECT unnest(p, recursive := true) FROM f) SELECT path, issue, count(*) AS n FROM u GROUP BY ALL")
def preference_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of a file of preference pairs by path and kind: structure, digests, ids of evaluation rows, repeated ids."""
    return preflight.by_issue(_dpo_lines(spark, sf), "id")


@query(_DPO_SQL + "SELECT count(*) AS n_rows, (SELECT count(*) FROM orders) AS n_expected, count(*) FILTER (len(p) > 0) AS n_bad, CAST(sum(len(p)) AS BIGINT) AS n_problems, count(*) FILTER (len(p) > 0) = 0 AND count(*) = (SELECT count(*) FROM orders) AS passed FROM f")
def preference_preflight(spark: SparkSession, sf: str) -> DataFrame:
    """The gate's verdict on that file: rows, faults, and whether it may be trained on."""
    return preflight.report(_dpo_lines(spark, sf), F.lit(table(spark, sf, "orders").count()), "id")
