"""Checks of a record's history, carried-over state and metadata, and greedy matching of slot values.

All are column expressions over the arrays of one record; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs that mean the same and their similarity, marks of refusal and of consent, and what normal forms of slot values drop.
SAME_MEANING = (("不吃花生", "花生过敏"), ("川菜", "四川菜"), ("生日", "生日宴"))
SAME_MEANING_SCORE = 0.91
REFUSAL, CONSENT = "不吃|不要|不能|过敏|忌", "可以吃|能吃|接受"
SLOT_NOISE = r"[\s,，。.!！?？、]+"
#: Similarity from which two values match.
THRESHOLD = 0.7


def slot_values(values: Column) -> Column:
    """Values without punctuation and white space; a null array is empty."""
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.regexp_replace(v, SLOT_NOISE, ""))


def same_meaning(a: Column, b: Column) -> Column:
    """1 for equal values, the fixed score for a known pair in either order, else 0."""
    known = F.lit(False)
    for x, y in SAME_MEANING:
        known = known | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return F.when(a == b, 1.0).when(known, SAME_MEANING_SCORE).otherwise(0.0)


def greedy_f1(expected: Column, predicted: Column, similarity: Callable[[Column, Column], Column] = same_meaning, threshold: float = THRESHOLD) -> Column:
    """F1 of two arrays of values, matched one to one from the most similar pair down; of equals the later places come first.

    A refusal never matches a consent. Two empty arrays have 1, an empty and a filled one 0. Repeated values count each."""

    def pair(e: Column, i: Column, p: Column, j: Column) -> Column:
        opposed = e.rlike(REFUSAL) & p.rlike(CONSENT)
        return F.struct(F.when(opposed, 0.0).otherwise(similarity(e, p)).alias("s"), i.alias("i"), j.alias("j"))

    pairs = F.flatten(F.transform(expected, lambda e, i: F.transform(predicted, lambda p, j: pair(e, i, p, j))))
    likely = F.sort_array(F.filter(pairs, lambda x: x["s"] >= threshold), asc=False)
    none = F.array().cast("array<int>")
    state = lambda used, taken: F.struct(used.alias("used"), taken.alias("taken"))
    free = lambda a, x: ~F.array_contains(a["used"], x["i"]) & ~F.array_contains(a["taken"], x["j"])
    matched = F.aggregate(
        likely, state(none, none),
        lambda a, x: F.when(free(a, x), state(F.array_append(a["used"], x["i"]), F.array_append(a["taken"], x["j"]))).otherwise(a),
        lambda a: F.size(a["used"]),
    )
    total = F.size(expected) + F.size(predicted)
    return F.when(total == 0, 1.0).otherwise(2.0 * matched / total)


def has_unpaired_result(history: Column) -> Column:
    """Whether a tool message of ``history`` (an array of role, call) answers no call that is open before it.

    Each answer closes its call. An empty history has none."""
    state = lambda pending, bad: F.struct(pending.alias("pending"), bad.alias("bad"))
    return F.aggregate(
        history, state(F.array().cast("array<bigint>"), F.lit(False)),
        lambda a, m: F.when(m["role"] == "assistant", state(F.array_append(a["pending"], m["call"]), a["bad"]))
        .when(m["role"] == "tool", state(F.array_remove(a["pending"], m["call"]), a["bad"] | ~F.array_contains(a["pending"], m["call"]))).otherwise(a),
        lambda a: a["bad"],
    )


def changed(before: Column, after: Column) -> Column:
    """Whether a known value became another known one; from or to null is no change of a query."""
    return F.coalesce(before != after, F.lit(False))


def disagrees(said: Column, actual: Column) -> Column:
    """Whether metadata that says something (not null, not empty) says other than what is there; null there counts as other."""
    return said.isNotNull() & (said != F.lit("")) & ~said.eqNullSafe(actual)
