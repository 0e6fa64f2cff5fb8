"""Rules over nested decision records: required slots, derived replies, issues, scores, flags and preference pairs.

A rule is a column that names an issue or is null; all rules of a set are computed in one pass and compacted into one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Required slots in order; what a tool's (mode, status) means as query status and reply type.
REQUIRED = ("service_date", "start_time", "people", "address")
STATUS = (
    ("search", "matched", "matched", "present_chef_candidates"),
    ("search", "no_match", "no_match", "inform_no_match"),
    ("search", "out_of_service_area", "out_of_service_area", "inform_out_of_service_area"),
    ("search", "error", "error", "booking_paused"),
    ("specific", "available", "available", "confirm_specific_chef"),
    ("specific", "unavailable", "unavailable", "present_alternatives"),
    ("specific", "not_found", "not_found", "inform_not_found"),
    ("specific", "out_of_service_area", "out_of_service_area", "inform_out_of_service_area"),
    ("specific", "error", "error", "booking_paused"),
)


def issues(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that are broken (a null verdict isn't)."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def missing_slots(slots: tuple[str, ...] = REQUIRED) -> Column:
    return issues(*[(s, F.col(s).isNull()) for s in slots])


def with_tool_status(df: DataFrame) -> DataFrame:
    """query_status and tool_reply for mode and status, not_checked where the pair is unknown."""
    known = F.broadcast(df.sparkSession.createDataFrame(list(STATUS), "mode string, status string, query_status string, tool_reply string"))  # nine rows
    return df.join(known, ["mode", "status"], "left").withColumn("query_status", F.coalesce("query_status", F.lit("not_checked")))


def reply_type(missing: Column) -> Column:
    """What is to be answered, by priority: confirmation, rejection, tool result, unrelated, missing slots."""
    return (
        F.when(F.col("confirms") & (F.col("query_status") == "available"), "booking_authorized")
        .when(F.col("rejects"), "booking_paused")
        .when(F.col("tool_reply").isNotNull(), F.col("tool_reply"))
        .when(F.col("unrelated"), "handoff")
        .when(F.size(missing) == 0, "acknowledge_result")
        .when(F.size(missing) == 1, F.concat(F.lit("ask_"), missing[0]))
        .otherwise("ask_multiple_required_fields")
    )


def f1(expected: Column, predicted: Column) -> Column:
    """F1 of two arrays of distinct values: 1 where both are empty, 0 where one is."""
    both = F.size(F.array_intersect(expected, predicted))
    total = F.size(expected) + F.size(predicted)
    return F.when(total == 0, 1.0).otherwise(2.0 * both / total)


def task_score(checks: list[Column], reply: Column) -> Column:
    """0.7 of the mean of the checks and 0.3 of the reply."""
    return F.round(0.7 * sum(checks[1:], checks[0]) / len(checks) + 0.3 * reply, 4)


def preference_pairs(df: DataFrame, key: str, perturbed: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row (key, heuristic, chosen, rejected) for each heuristic that changes something; no-ops are dropped."""
    each = F.array(*[F.struct(F.lit(h).alias("heuristic"), chosen.alias("chosen"), rejected.alias("rejected")) for h, (chosen, rejected) in perturbed.items()])
    return df.select(key, F.explode(each).alias("p")).select(key, "p.*").where(~F.col("chosen").eqNullSafe(F.col("rejected")))
