"""Queries that apply the decision rules to records made from orders and their lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.functions import text as tx
from millrace.operators import lineage, rules
from millrace.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def records(spark: SparkSession, sf: str, dealt: Callable[[DataFrame], DataFrame] = lambda orders: orders) -> DataFrame:
    """A decision record for each order: slots (some null), tool result, verified and predicted ids, flags. ``dealt`` deals orders (``o_orderkey``) that have their ids anew, before wider columns are made of them."""
    k = F.col("o_orderkey")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"])).alias("tool_ids"))
    slot = lambda every, value: F.when(k % every != 0, value)
    word = F.col("o_orderstatus")
    status = F.when(k % 2 == 0, F.when(word == "F", "matched").when(word == "O", "no_match").otherwise("error")).otherwise(F.when(word == "F", "available").when(word == "O", "unavailable").otherwise("odd"))
    # orders travel narrow and meet their lines by a shuffle at any size: what is made of the records costs far more than reading them, and tasks of a broadcast join are as few as the splits of orders
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    r = dealt(orders.join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")).select(
        k.alias("id"), F.col("o_custkey").alias("cust"), slot(5, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("service_date"), slot(7, F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30"))).alias("start_time"),
        slot(11, (k % 9 + 1).cast("long")).alias("people"), slot(13, F.concat(F.lit("addr-"), "o_custkey")).alias("address"),
        F.when(k % 2 == 0, "search").otherwise("specific").alias("mode"), status.alias("status"), (k % 17 == 0).alias("confirms"), (k % 19 == 0).alias("rejects"), (k % 23 == 0).alias("unrelated"),
        F.when(k % 3 == 0, F.array(F.lit("no peanuts"), F.lit("vegan"))).otherwise(F.array().cast("array<string>")).alias("diet"),
        F.when(k % 6 == 0, F.array(F.lit("vegan"))).when(k % 3 == 0, F.array(F.lit("vegan"), F.lit("no peanuts"))).otherwise(F.array().cast("array<string>")).alias("said_diet"),
        F.coalesce("tool_ids", F.array().cast("array<bigint>")).alias("tool_ids"),
    )
    return r.withColumn("said_ids", F.when(F.col("id") % 4 == 0, F.reverse("tool_ids")).otherwise(F.col("tool_ids"))).withColumn("chef_id", F.when(F.col("id") % 29 == 0, F.lit(-1).cast("long")).otherwise(F.get("tool_ids", F.lit(0))))


_RECORDS = """WITH l AS (SELECT l_orderkey, l_suppkey, min((l_linenumber, l_suppkey)) AS m FROM lineitem GROUP BY ALL), ids AS (SELECT l_orderkey, list(l_suppkey ORDER BY m) AS tool_ids FROM l GROUP BY l_orderkey),
o AS (SELECT o_orderkey AS id, CASE WHEN id % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS service_date, CASE WHEN id % 7 <> 0 THEN lpad(CAST(id % 24 AS VARCHAR), 2, '0') || ':30' END AS start_time,
 CASE WHEN id % 11 <> 0 THEN id % 9 + 1 END AS people, CASE WHEN id % 13 <> 0 THEN 'addr-' || o_custkey END AS address, CASE WHEN id % 2 = 0 THEN 'search' ELSE 'specific' END AS mode,
 CASE WHEN id % 2 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'matched' WHEN 'O' THEN 'no_match' ELSE 'error' END ELSE CASE o_orderstatus WHEN 'F' THEN 'available' WHEN 'O' THEN 'unavailable' ELSE 'odd' END END AS status,
 id % 17 = 0 AS confirms, id % 19 = 0 AS rejects, id % 23 = 0 AS unrelated, CASE WHEN id % 3 = 0 THEN ['no peanuts', 'vegan'] ELSE [] END AS diet, CASE WHEN id % 6 = 0 THEN ['vegan'] WHEN id % 3 = 0 THEN ['vegan', 'no peanuts'] ELSE [] END AS said_diet FROM orders),
r0 AS (SELECT o.*, coalesce(tool_ids, []) AS tool_ids FROM o LEFT JOIN ids ON l_orderkey = id),
r AS (SELECT *, CASE WHEN id % 4 = 0 THEN list_reverse(tool_ids) ELSE tool_ids END AS said_ids, CASE WHEN id % 29 = 0 THEN -1 ELSE tool_ids[1] END AS chef_id,
 list_filter([CASE WHEN service_date IS NULL THEN 'service_date' END, CASE WHEN start_time IS NULL THEN 'start_time' END, CASE WHEN people IS NULL THEN 'people' END, CASE WHEN address IS NULL THEN 'address' END], lambda x: x IS NOT NULL) AS missing FROM r0),
st(mode, status, query_status, tool_reply) AS (VALUES ('search', 'matched', 'matched', 'present_chef_candidates'), ('search', 'no_match', 'no_match', 'inform_no_match'), ('search', 'error', 'error', 'booking_paused'),
 ('specific', 'available', 'available', 'confirm_specific_chef'), ('specific', 'unavailable', 'unavailable', 'present_alternatives'))
"""
_REPLY = """CASE WHEN confirms AND query_status = 'available' THEN 'booking_authorized' WHEN rejects THEN 'booking_paused' WHEN tool_reply IS NOT NULL THEN tool_reply WHEN unrelated THEN 'handoff'
 WHEN len(missing) = 0 THEN 'acknowledge_result' WHEN len(missing) = 1 THEN 'ask_' || missing[1] ELSE 'ask_multiple_required_fields' END"""


@query(_RECORDS + f"SELECT id, coalesce(query_status, 'not_checked') AS query_status, {_REPLY} AS reply_type, array_to_string(missing, ',') AS missing FROM r LEFT JOIN st USING (mode, status)")
def scenario_facts_derive(spark: SparkSession, sf: str) -> DataFrame:
    """Derived query status, reply type and missing slots."""
    m = rules.missing_slots()
    r = rules.with_tool_status(records(spark, sf)).withColumn("m", m)
    return r.select("id", "query_status", rules.reply_type(F.col("m")).alias("reply_type"), F.array_join("m", ",").alias("missing"))


@query(_RECORDS + """SELECT mode, status, coalesce(query_status, 'not_checked') AS query_status, count(*) AS n, count(*) FILTER (query_status IS NULL) AS n_unknown FROM r LEFT JOIN st USING (mode, status) GROUP BY ALL""")
def tool_result_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by variant; a pair outside the nine is unknown."""
    return rules.with_tool_status(records(spark, sf)).groupBy("mode", "status", "query_status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tool_reply").isNull()).alias("n_unknown"))


@query(_RECORDS + """SELECT id, unnest(list_filter([CASE WHEN len(missing) > 0 AND id % 2 = 0 THEN 'info_complete' END, CASE WHEN said_ids <> tool_ids THEN 'candidate_order' END,
 CASE WHEN chef_id IS NOT NULL AND NOT list_contains(tool_ids, chef_id) THEN 'chef_not_verified' END, CASE WHEN unrelated AND len(tool_ids) > 0 THEN 'unrelated_with_tool' END,
 CASE WHEN service_date < '1993-01-01' THEN 'date_too_early' END], lambda x: x IS NOT NULL)) AS issue FROM r""")
def contract_decision_issues(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each broken rule of a record."""
    r = records(spark, sf).withColumn("m", rules.missing_slots())
    found = rules.issues(
        ("info_complete", (F.size("m") > 0) & (F.col("id") % 2 == 0)), ("candidate_order", F.col("said_ids") != F.col("tool_ids")), ("chef_not_verified", F.col("chef_id").isNotNull() & ~F.array_contains("tool_ids", F.col("chef_id"))),
        ("unrelated_with_tool", F.col("unrelated") & (F.size("tool_ids") > 0)), ("date_too_early", F.col("service_date") < "1993-01-01"),
    )
    return r.select("id", F.explode(found).alias("issue"))


@query(_RECORDS + """SELECT id, CAST(len(tool_ids) AS BIGINT) AS n_verified, coalesce(query_status, 'not_checked') AS latest_status, coalesce(list_contains(tool_ids, chef_id), false) AS chef_verified FROM r LEFT JOIN st USING (mode, status)""")
def tool_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What a record's tool result proves."""
    r = rules.with_tool_status(records(spark, sf))
    return r.select("id", F.size("tool_ids").cast("long").alias("n_verified"), F.col("query_status").alias("latest_status"), F.coalesce(F.array_contains("tool_ids", F.col("chef_id")), F.lit(False)).alias("chef_verified"))


_F1 = "CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


@query(_RECORDS + f"SELECT id, round({_F1.format(a='diet', b='said_diet')}, 6) AS f1 FROM r")
def semantic_slot_f1(spark: SparkSession, sf: str) -> DataFrame:
    """F1 of expected and predicted constraints, equal values matched."""
    return records(spark, sf).select("id", F.round(rules.f1(F.col("diet"), F.col("said_diet")), 6).alias("f1"))


@query(_RECORDS + f"""SELECT id, round(0.7 * ({_F1.format(a='diet', b='said_diet')} + CAST(said_ids = tool_ids AS INT) + CAST(coalesce(list_contains(tool_ids, chef_id), false) AS INT) + CAST(len(missing) = 0 AS INT)) / 4 + 0.3 * CAST(NOT unrelated AS INT), 4) AS score FROM r""")
def task_score(spark: SparkSession, sf: str) -> DataFrame:
    """0.7 of the mean of four checks and 0.3 of the reply."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    checks = [rules.f1(F.col("diet"), F.col("said_diet")), one(F.col("said_ids") == F.col("tool_ids")), one(F.array_contains("tool_ids", F.col("chef_id"))), one(F.size("m") == 0)]
    return records(spark, sf).withColumn("m", rules.missing_slots()).select("id", rules.task_score(checks, one(~F.col("unrelated"))).alias("score"))


@query(_RECORDS + """, a AS (SELECT unnest([{'name': 'tool_fact_grounded', 'ok': chef_id IS NULL OR list_contains(tool_ids, chef_id)}, {'name': 'candidate_order_preserved', 'ok': len(said_ids) = 0 OR said_ids = tool_ids},
 {'name': 'dietary_inherited', 'ok': list_has_all(said_diet, diet)}, {'name': 'calls_after_required_slots', 'ok': len(missing) = 0}], recursive := true) FROM r)
SELECT name, count(*) AS n, round(avg(CAST(ok AS INT)), 4) AS pass_rate FROM a GROUP BY name""")
def assertion_pass_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Pass rate of each assertion; all are computed in one pass."""
    named = {
        "tool_fact_grounded": F.col("chef_id").isNull() | F.array_contains("tool_ids", F.col("chef_id")),
        "candidate_order_preserved": (F.size("said_ids") == 0) | (F.col("said_ids") == F.col("tool_ids")),
        "dietary_inherited": F.size(F.array_except("diet", "said_diet")) == 0,
        "calls_after_required_slots": F.size(rules.missing_slots()) == 0,
    }
    each = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("ok")) for k, v in named.items()])
    a = records(spark, sf).select(F.explode(each).alias("a")).select("a.*")
    return a.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("int")), 4).alias("pass_rate"))


@query(_RECORDS + """SELECT id, array_to_string(list_sort(list_filter([CASE WHEN chef_id IS NOT NULL AND NOT list_contains(tool_ids, chef_id) THEN 'chef_fabrication' END, CASE WHEN NOT list_has_all(said_diet, diet) THEN 'dietary_constraint_loss_or_reversal' END,
 CASE WHEN confirms AND coalesce(query_status, 'not_checked') <> 'available' THEN 'unauthorized_booking' END, CASE WHEN len(said_ids) > 0 AND said_ids <> tool_ids THEN 'candidate_order_semantic_mutation' END], lambda x: x IS NOT NULL)), ',') AS tags FROM r LEFT JOIN st USING (mode, status)""")
def critical_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Critical tags of each record, sorted."""
    tags = rules.issues(
        ("chef_fabrication", F.col("chef_id").isNotNull() & ~F.array_contains("tool_ids", F.col("chef_id"))), ("dietary_constraint_loss_or_reversal", F.size(F.array_except("diet", "said_diet")) > 0),
        ("unauthorized_booking", F.col("confirms") & (F.col("query_status") != "available")), ("candidate_order_semantic_mutation", (F.size("said_ids") > 0) & (F.col("said_ids") != F.col("tool_ids"))),
    )
    return rules.with_tool_status(records(spark, sf)).select("id", F.array_join(F.array_sort(tags), ",").alias("tags"))


@query(_RECORDS + """, p AS (SELECT id, unnest([{'heuristic': 'H1', 'chosen': CAST(chef_id AS VARCHAR), 'rejected': 'chef_fake_999'}, {'heuristic': 'H4', 'chosen': array_to_string(diet, ','), 'rejected': ''},
 {'heuristic': 'H5', 'chosen': service_date, 'rejected': coalesce(strftime(CAST(service_date AS DATE) + 1, '%Y-%m-%d'), '2026-01-01')},
 {'heuristic': 'H8', 'chosen': array_to_string(tool_ids, ','), 'rejected': array_to_string(list_reverse(tool_ids), ',')}], recursive := true) FROM r)
SELECT id, heuristic, chosen, rejected FROM p WHERE chosen IS DISTINCT FROM rejected""")
def dpo_pairs_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Preference pairs by perturbation, without no-ops."""
    joined = lambda c: F.array_join(c, ",")
    return rules.preference_pairs(records(spark, sf), "id", {
        "H1": (F.col("chef_id").cast("string"), F.lit("chef_fake_999")),
        "H4": (joined(F.col("diet")), F.lit("")),
        "H5": (F.col("service_date"), F.coalesce(F.date_format(F.date_add(F.to_date("service_date"), 1), "yyyy-MM-dd"), F.lit("2026-01-01"))),
        "H8": (joined(F.col("tool_ids").cast("array<string>")), joined(F.reverse(F.col("tool_ids").cast("array<string>")))),
    })


@query(_RECORDS + """, h AS (SELECT id, 'H1' AS h FROM r WHERE status IN ('matched', 'available', 'unavailable') UNION ALL SELECT id, 'H4' FROM r WHERE len(diet) > 0 UNION ALL SELECT id, 'H8' FROM r WHERE len(tool_ids) > 1),
k AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY md5('3001|' || id), id) AS rank FROM h) SELECT id, h AS heuristic, CASE WHEN rank <= 3 THEN 'val' ELSE 'train' END AS split FROM k WHERE rank <= 30""")
def dpo_pairs_targeted(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty sources for each heuristic in a seeded order, three of them for validation (a quota operator)."""
    from millrace.operators.selection import ranked

    tags = rules.issues(("H1", F.col("status").isin("matched", "available", "unavailable")), ("H4", F.size("diet") > 0), ("H8", F.size("tool_ids") > 1))
    h = records(spark, sf).select("id", F.explode(tags).alias("heuristic"))
    r = ranked(h, "id", ["heuristic"], 3001).where("_rank <= 30")
    return r.select("id", "heuristic", F.when(F.col("_rank") <= 3, "val").otherwise("train").alias("split"))


@query(_RECORDS + """SELECT id, service_date IS NULL OR regexp_full_match(service_date, '\\d{4}-\\d{2}-\\d{2}') AS date_ok, start_time IS NULL OR regexp_full_match(start_time, '([01]\\d|2[0-3]):[0-5]\\d') AS time_ok FROM r""")
def runtime_input_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of dates and times."""
    return records(spark, sf).select("id", dates.is_calendar_day(F.col("service_date")).alias("date_ok"), dates.is_clock_time(F.col("start_time")).alias("time_ok"))


_VALUES = ("不吃花生", "花生过敏", "川菜", "四川菜", "生日", "生日宴", "可以吃花生")
_PICK = "list_filter([{v}], lambda x, i: (({n}) >> CAST(i - 1 AS BIGINT)) & 1 = 1)".format(v=", ".join(f"'{v}'" for v in _VALUES), n="{n}")
_MATCH = """list_reduce(list_concat([{'s': 0.0::DOUBLE, 'i': 0::BIGINT, 'j': 0::BIGINT, 'u': []::BIGINT[], 't': []::BIGINT[]}], m), lambda a, x: CASE WHEN list_contains(a.u, x.i) OR list_contains(a.t, x.j) THEN a
 ELSE {'s': 0.0::DOUBLE, 'i': 0::BIGINT, 'j': 0::BIGINT, 'u': list_append(a.u, x.i), 't': list_append(a.t, x.j)} END)"""


@query(f"""WITH v AS (SELECT o_orderkey AS id, {_PICK.format(n='o_orderkey')} AS e, {_PICK.format(n='o_orderkey // 5')} AS p FROM orders),
e AS (SELECT id, unnest(e) AS x, unnest(generate_series(1, len(e))) AS i FROM v), p AS (SELECT id, unnest(p) AS y, unnest(generate_series(1, len(p))) AS j FROM v),
s AS (SELECT id, i, j, CASE WHEN regexp_matches(x, '不吃|不要|不能|过敏|忌') AND regexp_matches(y, '可以吃|能吃|接受') THEN 0 WHEN x = y THEN 1
 WHEN (least(x, y), greatest(x, y)) IN (('不吃花生', '花生过敏'), ('四川菜', '川菜'), ('生日', '生日宴')) THEN 0.91 ELSE 0 END AS s FROM e JOIN p USING (id)),
m AS (SELECT id, list({{'s': s::DOUBLE, 'i': i::BIGINT, 'j': j::BIGINT, 'u': []::BIGINT[], 't': []::BIGINT[]}} ORDER BY s DESC, i DESC, j DESC) AS m FROM s WHERE s >= 0.7 GROUP BY id)
SELECT v.id, round(CASE WHEN len(e) + len(p) = 0 THEN 1 WHEN m IS NULL THEN 0 ELSE 2.0 * len(({_MATCH}).u) / (len(e) + len(p)) END, 6) AS f1 FROM v LEFT JOIN m ON m.id = v.id""")
def semantic_slot_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """F1 of expected and predicted values, similar ones matched too, one to one; the predicted ones carry punctuation."""
    pick = lambda n: F.array_compact(F.array(*[F.when(F.shiftright(n, k).bitwiseAND(1) == 1, F.lit(v)) for k, v in enumerate(_VALUES)]))
    k = F.col("o_orderkey")
    v = table(spark, sf, "orders").select(k.alias("id"), pick(k).alias("e"), F.transform(pick(F.floor(k / 5).cast("long")), lambda x: F.concat(x, F.lit("。 "))).alias("p"))
    return v.select("id", F.round(lineage.greedy_f1(lineage.slot_values(F.col("e")), lineage.slot_values(F.col("p"))), 6).alias("f1"))


_OPEN = """list_reduce(list_concat([{'role': '', 'call': 0::BIGINT, 'pending': []::BIGINT[], 'bad': false}], history), lambda a, m: CASE WHEN m.role = 'assistant' THEN {'role': '', 'call': 0::BIGINT, 'pending': list_append(a.pending, m.call), 'bad': a.bad}
 ELSE {'role': '', 'call': 0::BIGINT, 'pending': list_filter(a.pending, lambda c: c <> m.call), 'bad': a.bad OR NOT list_contains(a.pending, m.call)} END).bad"""
_SENT = "{{'role': '{r}', 'call': {c}::BIGINT, 'pending': []::BIGINT[], 'bad': false}}"


@query(_RECORDS + f""", h AS (SELECT *, flatten(list_transform(tool_ids, lambda x: CASE WHEN id % 41 = 0 THEN [{_SENT.format(r='tool', c='x')}, {_SENT.format(r='assistant', c='x')}] WHEN id % 43 = 0 THEN [{_SENT.format(r='assistant', c='x')}, {_SENT.format(r='tool', c='(x + 1)')}]
 ELSE [{_SENT.format(r='assistant', c='x')}, {_SENT.format(r='tool', c='x')}] END)) AS history, CASE WHEN id % 31 = 0 THEN NULL WHEN id % 4 = 1 THEN 'search' ELSE mode END AS meta_mode, CASE WHEN id % 8 = 0 THEN 'matched' WHEN id % 10 = 0 THEN '' ELSE status END AS meta_status,
 CASE WHEN id % 12 = 0 THEN people + 1 WHEN id % 26 = 0 THEN NULL ELSE people END AS new_people FROM r)
SELECT id, unnest(list_filter([CASE WHEN {_OPEN} THEN 'result_without_call' END, CASE WHEN people <> new_people AND len(said_ids) > 0 THEN 'stale_result' END, CASE WHEN id % 2 = 0 AND people IS DISTINCT FROM new_people THEN 'preserved_changed' END,
 CASE WHEN id % 3 = 0 AND chef_id IS NOT NULL THEN 'invalidated_kept' END, CASE WHEN meta_mode <> '' AND meta_mode IS DISTINCT FROM mode THEN 'mode_mismatch' END, CASE WHEN meta_status <> '' AND meta_status IS DISTINCT FROM status THEN 'status_mismatch' END,
 CASE WHEN len(said_ids) > 0 AND len(tool_ids) > 0 AND said_ids <> tool_ids THEN 'order_mismatch' END], lambda x: x IS NOT NULL)) AS issue FROM h""")
def lineage_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Broken rules of call pairing, stale results, carried-over state and metadata, a row for each."""
    k = F.col("id")
    sent = lambda role, call: F.struct(F.lit(role).alias("role"), call.alias("call"))
    turns = lambda x: F.when(k % 41 == 0, F.array(sent("tool", x), sent("assistant", x))).when(k % 43 == 0, F.array(sent("assistant", x), sent("tool", x + 1))).otherwise(F.array(sent("assistant", x), sent("tool", x)))
    r = records(spark, sf).withColumns({
        "history": F.flatten(F.transform("tool_ids", turns)), "meta_mode": F.when(k % 31 == 0, None).when(k % 4 == 1, "search").otherwise(F.col("mode")), "meta_status": F.when(k % 8 == 0, "matched").when(k % 10 == 0, "").otherwise(F.col("status")),
        "new_people": F.when(k % 12 == 0, F.col("people") + 1).when(k % 26 == 0, None).otherwise(F.col("people")),
    })
    found = rules.issues(
        ("result_without_call", lineage.has_unpaired_result(F.col("history"))), ("stale_result", lineage.changed(F.col("people"), F.col("new_people")) & (F.size("said_ids") > 0)),
        ("preserved_changed", (k % 2 == 0) & ~F.col("people").eqNullSafe(F.col("new_people"))), ("invalidated_kept", (k % 3 == 0) & F.col("chef_id").isNotNull()),
        ("mode_mismatch", lineage.disagrees(F.col("meta_mode"), F.col("mode"))), ("status_mismatch", lineage.disagrees(F.col("meta_status"), F.col("status"))),
        ("order_mismatch", (F.size("said_ids") > 0) & (F.size("tool_ids") > 0) & (F.col("said_ids") != F.col("tool_ids"))),
    )
    return r.select("id", F.explode(found).alias("issue"))


_SAID = ("确认","可以", "好的", "不可以", "取消预约", "可以吗", "行", "没问题的", "我想换一个", "就他", "请就这样", "别订了", "")


@query("SELECT * FROM (VALUES ('确认', true), ('可以', true), ('好的', true), ('不可以', false), ('取消预约', false), ('可以吗', true), ('行', true), ('没问题的', true), ('我想换一个', false), ('就他', true), ('请就这样', true), ('别订了', false), ('', false)) v(said, affirmative)")
def affirmative_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s in _SAID], "said string").select("said", tx.is_affirmative(F.col("said")).alias("affirmative"))
