"""Queries on labels, events and orders: scorecards, latency, comparisons, gates, matrices and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.operators import reports
from millrace.shared import move, new_path
from millrace.sources.tables import predictions, stream_text, table
from millrace.streaming import runs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_CASES = "(SELECT d.doc_id, d.lang, d.source, l.quality = 1 AS protocol, l.toxic = 1 AS critical, round(least(d.n_chars, 2000) / 2000.0, 4) AS task FROM documents d JOIN labels l USING (doc_id))"


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as scored cases."""
    j = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return j.select("doc_id", "lang", "source", (F.col("quality") == 1).alias("protocol"), (F.col("toxic") == 1).alias("critical"), F.round(F.least("n_chars", F.lit(2000)) / 2000.0, 4).alias("task"))


_CARD = """count(*) AS n, round(avg(CAST(protocol AS INT)), 4) AS protocol_rate, round(avg(task), 4) AS task_mean, round(avg(CAST(critical AS INT)), 4) AS critical_rate,
 round(avg(CAST(protocol AND task >= 0.95 AND NOT critical AS INT)), 4) AS effective_rate"""


@query(f"SELECT {_CARD} FROM {_CASES}")
def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return reports.scorecard(cases(spark, sf), [])


@query(f"SELECT lang, {_CARD} FROM {_CASES} GROUP BY lang")
def tag_slices(spark: SparkSession, sf: str) -> DataFrame:
    """A scorecard for each language."""
    return reports.scorecard(cases(spark, sf), ["lang"])


@query(f"SELECT source, protocol, critical, count(*) AS n FROM {_CASES} GROUP BY ALL")
def critical_error_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).groupBy("source", "protocol", "critical").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'missing_mock_prediction' END AS error FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def predictions_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every case with its prediction; a missing one is an error row."""
    label = table(spark, sf, "labels").select("doc_id", "quality", F.lit(1).alias("hit"))
    j = table(spark, sf, "documents").select("doc_id").join(label, "doc_id", "left")
    return j.select("doc_id", "quality", F.when(F.col("hit").isNull(), "missing_mock_prediction").alias("error"))


@query("""SELECT (SELECT count(*) FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id) AS missing, (SELECT count(*) FROM labels l ANTI JOIN documents d ON l.doc_id = d.doc_id) AS extra""")
def id_set_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Ids on one side only, from one full outer join."""
    a = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("a"))
    b = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("b"))
    return a.join(b, "doc_id", "full").agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"))


@query(f"""WITH f AS (SELECT doc_id, unnest(list_filter([CASE WHEN NOT protocol THEN 'protocol' END, CASE WHEN critical THEN 'critical' END, CASE WHEN task < 0.5 THEN 'task' END], lambda x: x IS NOT NULL)) AS tag FROM {_CASES})
SELECT tag, doc_id FROM f""")
def failure_export(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each failed case and tag."""
    tags = F.array_compact(F.array(F.when(~F.col("protocol"), "protocol"), F.when(F.col("critical"), "critical"), F.when(F.col("task") < 0.5, "task")))
    return cases(spark, sf).select(F.explode(tags).alias("tag"), "doc_id")


@query(f"""SELECT CASE WHEN task < 0.5 THEN '<0.50' WHEN task < 0.8 THEN '0.50-0.80' WHEN task < 0.95 THEN '0.80-0.95' ELSE 'passed' END AS bucket, count(*) AS n FROM {_CASES} WHERE protocol GROUP BY 1""")
def score_buckets(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("task")
    bucket = F.when(t < 0.5, "<0.50").when(t < 0.8, "0.50-0.80").when(t < 0.95, "0.80-0.95").otherwise("passed")
    return cases(spark, sf).where("protocol").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT CASE WHEN critical THEN 'critical' WHEN NOT protocol THEN 'protocol' WHEN task < 0.5 THEN 'task_low' WHEN task < 0.95 THEN 'task' ELSE 'none' END AS failure, count(*) AS n FROM {_CASES} GROUP BY 1""")
def failure_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """The first failure class that applies."""
    kind = F.when(F.col("critical"), "critical").when(~F.col("protocol"), "protocol").when(F.col("task") < 0.5, "task_low").when(F.col("task") < 0.95, "task").otherwise("none")
    return cases(spark, sf).groupBy(kind.alias("failure")).agg(F.count(F.lit(1)).alias("n"))


_GOOD = "FILTER (event_type <> 'error' AND value > 0)"


@query(f"""SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed, round(avg(value) {_GOOD}, 4) AS mean, round(quantile_cont(value, 0.5) {_GOOD}, 4) AS p50, round(quantile_cont(value, 0.95) {_GOOD}, 4) AS p95 FROM events GROUP BY user_id""")
def latency_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return reports.latency(table(spark, sf, "events"), ["user_id"])


@query("""SELECT user_id, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def latency_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return reports.nearest_rank(table(spark, sf, "events"), ["user_id"], 0.95)


@query("""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens, value * 10 AS latency_ms, value AS first_ms, CASE WHEN event_type = 'click' THEN value END AS native FROM events)
SELECT event_id, round(CASE WHEN native > 0 THEN native WHEN latency_ms > first_ms AND tokens > 1 THEN (tokens - 1) / ((latency_ms - first_ms) / 1000) END, 4) AS tps, CASE WHEN native > 0 THEN 'server' WHEN latency_ms > first_ms AND tokens > 1 THEN 'clock' END AS tps_source FROM e""")
def throughput_resolution(spark: SparkSession, sf: str) -> DataFrame:
    tps, source = reports.throughput(F.get_json_object("props", "$.k").cast("long"), F.col("value") * 10, F.col("value"), F.when(F.col("event_type") == "click", F.col("value")))
    return table(spark, sf, "events").select("event_id", tps.alias("tps"), source.alias("tps_source"))


@query("""SELECT event_id, array_to_string(json_keys(props), ',') AS keys, json_keys(props) = ['k'] AS exact, json_type(props, '$.k') AS kind FROM events""")
def json_key_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of embedded JSON, whether they are just those expected, and the type of the value."""
    keys = F.json_object_keys("props")
    kind = F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")) == "BIGINT", "UBIGINT")
    return table(spark, sf, "events").select("event_id", F.array_join(keys, ",").alias("keys"), ((F.size(keys) == 1) & F.array_contains(keys, "k")).alias("exact"), kind.alias("kind"))


_RUN = "SELECT 'r' || (user_id % 4) AS run, user_id * 1000 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, (user_id // 4) * 1000 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS case_id, event_type <> 'error' AS passed, value FROM events"


def run_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Events as cases of four runs: case_id pairs up the n-th events of users with one quotient."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf, "events").select(F.concat(F.lit("r"), F.col("user_id") % 4).alias("run"), (F.floor(F.col("user_id") / 4) * 1000 + n).alias("case_id"), (F.col("event_type") != "error").alias("passed"), "value")


def _pairs(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([("r0", "r1"), ("r0", "r2"), ("r1", "r3"), ("r0", "r9")], "parent string, child string"))


_PAIRS = "(VALUES ('r0', 'r1'), ('r0', 'r2'), ('r1', 'r3'), ('r0', 'r9')) p(parent, child)"


@query(f"""WITH c AS ({_RUN}) SELECT parent, child, count(*) FILTER (NOT a.passed AND b.passed) AS improved, count(*) FILTER (a.passed AND NOT b.passed) AS regressed, count(*) FILTER (a.passed = b.passed) AS unchanged,
 count(*) FILTER (NOT a.passed AND b.passed) - count(*) FILTER (a.passed AND NOT b.passed) AS net FROM {_PAIRS} JOIN c a ON a.run = parent JOIN c b ON b.run = child AND a.case_id = b.case_id GROUP BY parent, child""")
def case_diff(spark: SparkSession, sf: str) -> DataFrame:
    return reports.case_diff(run_cases(spark, sf), _pairs(spark))


_CELLS = f"(SELECT run, count(*) AS n, round(avg(CAST(passed AS INT)), 4) AS protocol_rate, round(avg(value), 4) AS value_mean FROM ({_RUN}) GROUP BY run)"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return run_cases(spark, sf).groupBy("run").agg(F.count(F.lit(1)).alias("n"), reports.rate(F.col("passed")).alias("protocol_rate"), F.round(F.avg("value"), 4).alias("value_mean"))


@query(f"SELECT * FROM {_CELLS}")
def cell_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf)


@query(f"""SELECT parent, child, round(b.protocol_rate - a.protocol_rate, 4) AS d_protocol_rate, round(b.value_mean - a.value_mean, 4) AS d_value_mean FROM {_PAIRS} LEFT JOIN {_CELLS} a ON a.run = parent LEFT JOIN {_CELLS} b ON b.run = child""")
def run_comparison_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of metrics for pairs of runs; null where a run is missing."""
    return reports.deltas(cells(spark, sf), "run", _pairs(spark), ["protocol_rate", "value_mean"])


@query(f"""SELECT run, protocol_rate, value_mean, protocol_rate >= 0.7 AS passed FROM {_CELLS} ORDER BY protocol_rate DESC, value_mean, run LIMIT 1""")
def select_best_run(spark: SparkSession, sf: str) -> DataFrame:
    """The best run by several keys, and its gate."""
    top = reports.best(cells(spark, sf), [F.col("protocol_rate").desc(), F.col("value_mean"), F.col("run")])
    return top.select("run", "protocol_rate", "value_mean", (F.col("protocol_rate") >= 0.7).alias("passed"))


@query(f"""WITH c AS ({_RUN}), d AS (SELECT avg(CAST(passed AS INT)) FILTER (run = 'r1') - avg(CAST(passed AS INT)) FILTER (run = 'r0') AS x FROM c)
SELECT round(x, 4) AS delta, CASE WHEN round(x, 4) >= 0.05 THEN 'better' WHEN round(x, 4) <= -0.05 THEN 'worse' ELSE 'same' END AS verdict FROM d""")
def ab_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Difference of two arms and a verdict."""
    p = lambda r: F.avg(F.when(F.col("run") == r, F.col("passed").cast("int")))
    d = run_cases(spark, sf).agg(F.round(p("r1") - p("r0"), 4).alias("delta"))
    return d.withColumn("verdict", F.when(F.col("delta") >= 0.05, "better").when(F.col("delta") <= -0.05, "worse").otherwise("same"))


@query(f"""SELECT count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS n_cases, count(DISTINCT run) AS n_models, round(max(protocol_rate), 4) AS best FROM {_CELLS}""")
def runs_summary(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_cases"), F.count_distinct("run").alias("n_models"), F.max("protocol_rate").alias("best"))


_MATRIX = """(SELECT model || '-' || stage || CASE WHEN beta > 0 THEN '-b' || CAST(beta AS VARCHAR) ELSE '' END || '-' || variant AS run_id, model, stage, beta, variant FROM (VALUES ('small'), ('large')) m(model),
 (VALUES ('sft', 0), ('dpo', 1), ('dpo', 3)) s(stage, beta), (VALUES ('u'), ('s')) v(variant))"""


def matrix(spark: SparkSession) -> DataFrame:
    """Model x (sft, dpo with two betas) x variant: twelve runs, from literal dimensions."""
    m = spark.createDataFrame([("small",), ("large",)], "model string")
    s = spark.createDataFrame([("sft", 0), ("dpo", 1), ("dpo", 3)], "stage string, beta int")
    v = spark.createDataFrame([("u",), ("s",)], "variant string")
    run = F.concat("model", F.lit("-"), "stage", F.when(F.col("beta") > 0, F.concat(F.lit("-b"), F.col("beta"))).otherwise(F.lit("")), F.lit("-"), "variant")
    return m.crossJoin(s).crossJoin(v).select(run.alias("run_id"), "model", "stage", "beta", "variant")


@query(f"SELECT * FROM {_MATRIX}")
def eval_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return matrix(spark)


@query(f"SELECT model, count(*) AS n, count(DISTINCT run_id) AS n_ids, count(DISTINCT variant) = 2 AS paired FROM {_MATRIX} GROUP BY model")
def matrix_checks(spark: SparkSession, sf: str) -> DataFrame:
    return matrix(spark).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("n_ids"), (F.count_distinct("variant") == 2).alias("paired"))


@query(f"SELECT run_id FROM {_MATRIX} WHERE run_id NOT IN ('small-sft-u', 'small-sft-s', 'large-dpo-b3-u')")
def matrix_missing_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs not yet complete: an anti join."""
    done = spark.createDataFrame([("small-sft-u",), ("small-sft-s",), ("large-dpo-b3-u",)], "run_id string")
    return matrix(spark).select("run_id").join(done, "run_id", "left_anti")


_PLAN = "(VALUES ('missing_required_slots', 'easy', 60), ('valid_search_tool_call', 'medium', 100), ('state_inheritance', 'medium', 60), ('dietary_modification', 'hard', 40), ('rejection', 'easy', 30), ('unrelated', 'easy', 30)) p(scenario, difficulty, quota)"


@query(f"SELECT scenario || '-' || lpad(CAST(i AS VARCHAR), 3, '0') AS id, scenario, difficulty, CAST((i - 1) % 12 AS INT) AS time_kind FROM (SELECT *, unnest(generate_series(1, quota)) AS i FROM {_PLAN})")
def plan_expand(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each sample of the plan, its time expression dealt round-robin."""
    rows = [("missing_required_slots", "easy", 60), ("valid_search_tool_call", "medium", 100), ("state_inheritance", "medium", 60), ("dietary_modification", "hard", 40), ("rejection", "easy", 30), ("unrelated", "easy", 30)]
    p = spark.createDataFrame(rows, "scenario string, difficulty string, quota int").withColumn("i", F.explode(F.sequence(F.lit(1), "quota")))
    return p.select(F.concat("scenario", F.lit("-"), F.lpad(F.col("i").cast("string"), 3, "0")).alias("id"), "scenario", "difficulty", F.pmod(F.col("i") - 1, F.lit(12)).alias("time_kind"))


_D = "CAST(o_orderdate AS DATE)"
_ON = "CAST({d} + CAST((({w} - (isodow({d}) - 1)) % 7 + 7) % 7 AS INTEGER) AS DATE)"


@query(f"""SELECT o_orderkey, {_D} AS today, {_D} AS tonight, {_D} + 1 AS tomorrow, {_D} + 1 AS tomorrow_evening, {_D} + 2 AS day_after_tomorrow, {_ON.format(d=_D, w=5)} AS this_weekend_saturday, {_ON.format(d=_D, w=6)} AS this_weekend_sunday, {_ON.format(d=_D, w=5)} AS this_saturday, {_ON.format(d=_D, w=6)} AS this_sunday,
 {_ON.format(d=f"({_D} + 1)", w=0)} AS next_monday, {_ON.format(d=f"({_D} + 1)", w=4)} AS next_friday, {_ON.format(d=f"({_D} + 1)", w=5)} AS next_weekend FROM orders""")
def relative_dates(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", *[dates.relative(n, day).alias(n) for n in dates.RELATIVE])


@query("""WITH l AS (SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_suppkey) AS shown, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey, l_linenumber) AS sorted FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, shown, shown = sorted AS in_order FROM orders JOIN l ON o_orderkey = l_orderkey""")
def order_nested_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates nested under their order, and whether their sequence is the sorted one."""
    c = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("c"))
    shown = F.array_join(F.transform("c", lambda x: x["l_suppkey"].cast("string")), ",")
    sorted_ = F.array_join(F.transform(F.array_sort(F.transform("c", lambda x: F.struct(x["l_suppkey"], x["l_linenumber"]))), lambda x: x["l_suppkey"].cast("string")), ",")
    return table(spark, sf, "orders").select("o_orderkey").join(c, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", shown.alias("shown"), (shown == sorted_).alias("in_order"))


@query("SELECT * FROM (VALUES ('a', 'one'), ('b', NULL), ('c', 'three')) v(case_id, raw_text)")
def predictions_map_explode(spark: SparkSession, sf: str) -> DataFrame:
    maps = spark.createDataFrame([('{"a": {"raw_text": "one"}, "b": {}}',), ('{"c": {"raw_text": "three"}}',)], "value string")
    return predictions(maps)


@query("SELECT * FROM (VALUES ('r1', 'Hello', 2::BIGINT, 1::BIGINT), ('r2', 'x', 1::BIGINT, 3::BIGINT)) v(run, text, n_deltas, first_pos)")
def sse_log_parse(spark: SparkSession, sf: str) -> DataFrame:
    lines = [("r1", 1, 'data: {"delta": "Hel"}'), ("r1", 2, ": ping"), ("r1", 3, 'data: {"delta": "lo"}'), ("r1", 4, "data: [DONE]"), ("r1", 5, 'data: {"delta": "late"}'), ("r2", 2, "data: {broken"), ("r2", 3, 'data: {"delta": "x"}')]
    return stream_text(spark.createDataFrame(lines, "run string, pos long, line string"))


@query("""WITH e AS (SELECT event_type, value, value / 10 AS first, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens FROM events)
SELECT 'all' AS scope, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed, round(avg(value) FILTER (event_type <> 'error' AND value > 0), 4) AS mean, round(quantile_cont(value, 0.5) FILTER (event_type <> 'error' AND value > 0), 4) AS p50, round(quantile_cont(value, 0.95) FILTER (event_type <> 'error' AND value > 0), 4) AS p95 FROM e""")
def latency_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """The latency report of all events as one group."""
    return reports.latency(table(spark, sf, "events").withColumn("scope", F.lit("all")), ["scope"])


#: Milliseconds without an event after which a run is cut; how event types read as a token stream's.
_GAP = 6 * 3_600_000
_KINDS = {"click": "token", "view": "token", "purchase": "figure", "signup": "end", "error": "error"}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " ELSE 'other' END"
_RUNS_SQL = f"""WITH e AS (SELECT user_id AS run, epoch_us(ts) // 1000 AS ms, {_KIND_SQL} AS kind, value FROM events),
o AS (SELECT *, row_number() OVER w AS place, lag(ms) OVER w AS before, lag(kind) OVER w AS was FROM e WINDOW w AS (PARTITION BY run ORDER BY ms, CASE kind WHEN 'token' THEN 0 WHEN 'figure' THEN 1 WHEN 'end' THEN 3 WHEN 'error' THEN 3 ELSE 2 END, kind, value NULLS LAST)),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR was IN ('end', 'error') OR ms - before > {_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY place) AS no FROM o)
SELECT run, min(ms) AS started_ms, min(ms) FILTER (kind = 'token') AS first_token_ms, max(ms) AS last_ms, count(*) AS n_events, count(*) FILTER (kind = 'token') AS n_tokens, arg_max(value, place) FILTER (kind = 'figure') AS figure,
 CASE WHEN arg_max(kind, place) IN ('end', 'error') THEN arg_max(kind, place) ELSE 'cut' END AS outcome FROM n GROUP BY run, no"""


def _run_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[F.col("event_type")], F.lit("other"))
    return table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), "value")


@query(_RUNS_SQL)
def run_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Token streams of each user's events: first token, counts, the server's figure, and how they stopped."""
    return runs.runs_of_table(_run_events(spark, sf), _GAP)


@query(_RUNS_SQL)
def run_telemetry_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a stateful stream over the events in folders by time, five days a batch at any size; an event far later makes the timers close what is left open."""
    e = _run_events(spark, sf)
    path = new_path(spark, "event-stream")
    days = F.expr("unix_seconds(at) div (5 * 86400)")
    first, last = e.agg(F.min(days), F.max(days)).first()
    # the events are read once; each five days are then a folder
    e.withColumn("days", days).write.partitionBy("days").parquet(f"{path}/days")
    by_days = spark.read.schema(e.withColumn("days", days).schema).parquet(f"{path}/days")
    e.limit(0).write.parquet(f"{path}/in/none")
    end = e.agg(F.max("at").alias("at")).select(F.lit(-1).cast("long").alias("run"), (F.coalesce("at", F.current_timestamp()) + F.expr("INTERVAL 30 DAYS")).alias("at"), F.lit("end").alias("kind"), F.lit(None).cast("double").alias("value"))
    chunks = {n: by_days.where(F.col("days") == n).drop("days") for n in (range(first, last + 1) if first is not None else ())}
    stream = runs.runs(spark.readStream.schema(e.schema).parquet(f"{path}/in/*"), _GAP, "6 days").writeStream.format("parquet").option("checkpointLocation", f"{path}/progress")
    # the next five days come when the stream has taken those before, in however many files: batches grow in size, not in number. Within them events come in any order, which the watermark allows for
    timers = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(timers)
    spark.conf.set(timers, "false")  # timers may wait for the next batch while one follows
    try:
        told = stream.start(f"{path}/out")
    finally:
        spark.conf.set(timers, before)
    try:
        for n, chunk in chunks.items():
            # the stream, which looks for files all the time, finds a folder's at once: those of a writer come one by one, and made batches of their own
            chunk.write.parquet(f"{path}/next/{n}")
            move(spark, f"{path}/next/{n}", f"{path}/in/{n}")
            told.processAllAvailable()
    finally:
        told.stop()
    end.write.parquet(f"{path}/in/end")
    stream.trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out").where("run <> -1")
