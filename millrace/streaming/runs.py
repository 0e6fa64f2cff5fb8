"""Telemetry of token streams by run: first token, tokens, the server's own figure, and runs that stop without an end.

Events of a run are one stream until an end or an error, or until none has come for ``gap`` milliseconds: then it is cut. Events may arrive in any order within the watermark: they wait in the
state of their run until the watermark has passed them, and are then taken in the order of their time, so the result doesn't depend on how they came in. A timer of event time closes cut
streams even if the run never speaks again. Events later than the watermark are dropped, as in any such query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Kinds of events. Any other kind only shows that the run is alive.
TOKEN, FIGURE, END, ERROR = "token", "figure", "end", "error"
OUTPUT = "run long, started_ms long, first_token_ms long, last_ms long, n_events long, n_tokens long, figure double, outcome string"
#: What each order of equal times and kinds is.
_ORDER = {TOKEN: 0, FIGURE: 1, END: 3, ERROR: 3}


def _closed(run: int, s: dict, outcome: str) -> tuple:
    return run, s["started"], s["first"], s["last"], s["events"], s["tokens"], s["figure"], outcome


def _advance(run: int, state: dict, until: int, gap: int) -> list[tuple]:
    """Takes all waiting events before ``until`` in order; the streams that closed."""
    ready = sorted((e for e in state["waiting"] if e[0] < until), key=lambda e: (e[0], _ORDER.get(e[1], 2), e[1], e[2] is None, e[2] or 0))
    state["waiting"] = [e for e in state["waiting"] if e[0] >= until]
    out, now = [], state["open"]
    for at, kind, value in ready:
        if now and at - now["last"] > gap:
            out.append(_closed(run, now, "cut"))
            now = None
        now = now or {"started": at, "first": None, "last": at, "events": 0, "tokens": 0, "figure": None}
        now["last"], now["events"] = at, now["events"] + 1
        if kind == TOKEN:
            now["tokens"] += 1
            now["first"] = at if now["first"] is None else now["first"]
        elif kind == FIGURE:
            now["figure"] = value
        elif kind in (END, ERROR):
            out.append(_closed(run, now, kind))
            now = None
    if now and until - now["last"] > gap:
        out.append(_closed(run, now, "cut"))
        now = None
    state["open"] = now
    return out


def runs(events: DataFrame, gap: int, late: str) -> DataFrame:
    """A row for each closed stream of a streaming table (run, at: timestamp, kind, value). ``late``: how much later than others an event may come, as an interval."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {"waiting": [], "open": None}
        for f in frames:
            state["waiting"] += [[int(a), k, None if pd.isna(v) else float(v)] for a, k, v in zip(f["ms"], f["kind"], f["value"], strict=True)]
        until = held.getCurrentWatermarkMs()
        out = _advance(key[0], state, until, gap)
        if state["waiting"] or state["open"]:
            held.update((json.dumps(state),))
            due = [min(e[0] for e in state["waiting"]) + 1] if state["waiting"] else []
            due += [state["open"]["last"] + gap + 1] if state["open"] else []
            held.setTimeoutTimestamp(max(min(due), until + 1))
        elif held.exists:
            held.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    timed = events.select("run", "at", "kind", "value", F.unix_millis("at").alias("ms")).withWatermark("at", late)
    return timed.groupBy("run").applyInPandasWithState(step, OUTPUT, "waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def runs_of_table(events: DataFrame, gap: int) -> DataFrame:
    """The same over a whole table, by windows; the last stream of a run counts as cut unless it has ended."""
    order = F.when(F.col("kind") == TOKEN, 0).when(F.col("kind") == FIGURE, 1).when(F.col("kind").isin(END, ERROR), 3).otherwise(2)
    w = Window.partitionBy("run").orderBy("ms", order, "kind", F.col("value").asc_nulls_last())
    e = events.select("run", "kind", "value", F.unix_millis("at").alias("ms"))
    before = F.lag(F.struct("ms", "kind")).over(w)
    opens = F.coalesce(before["kind"].isin(END, ERROR) | (F.col("ms") - before["ms"] > gap), F.lit(True))
    e = e.withColumns({"opens": opens.cast("int"), "place": F.row_number().over(w)})
    e = e.withColumn("no", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by("kind", "place")
    return e.groupBy("run", "no").agg(
        F.min("ms").alias("started_ms"), F.min(F.when(F.col("kind") == TOKEN, F.col("ms"))).alias("first_token_ms"), F.max("ms").alias("last_ms"), F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("kind") == TOKEN).alias("n_tokens"),
        F.max_by("value", F.when(F.col("kind") == FIGURE, F.col("place"))).alias("figure"), F.when(last.isin(END, ERROR), last).otherwise("cut").alias("outcome"),
    ).drop("no")
