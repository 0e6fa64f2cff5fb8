"""Picks from bounded candidates against the walk over all items."""

import random

import pytest

from millrace.operators import coverage as c

CAPS = {"easy": 4, "medium": 3, "hard": 2}
LABELS = [f"l{i}" for i in range(12)]


@pytest.mark.parametrize("seed", range(4))
def test_same_picks_as_over_all_items(spark, seed):
    rng = random.Random(seed)
    n = (30, 300, 2000, 8)[seed]
    rows = [(i * 3, rng.choice([*CAPS, "other"])) for i in range(n)]
    # rare labels, one that nothing has, and one that nearly all have
    tags = [(i, x) for i, _ in rows for k, x in enumerate(LABELS[:-1]) if rng.random() < (0.9 if k == 0 else 0.3 / (k * k))]
    preferred = {b: rng.sample(LABELS, 4) for b in CAPS}
    items = spark.createDataFrame([*rows, rows[0], (None, "easy"), (1, None)], "id long, level string").repartition(3)
    labels = spark.createDataFrame([*tags, *tags[:3], (None, "l1"), (0, None), (0, "unnamed")], "id long, label string").repartition(3)
    of = {}
    for i, x in tags:
        of.setdefault(i, set()).add(x)
    every = [(i, b, frozenset(of.get(i, ()))) for i, b in sorted(rows)]
    picks, how = c.walk(every, CAPS, preferred, LABELS)
    got = c.coverage_pick(items, labels, "id", "level", CAPS, preferred, LABELS)
    assert sorted((r.level, r.place, r.id) for r in got.collect()) == sorted((b, k, i) for b, ids in picks.items() for k, i in enumerate(ids, 1))
    assert how["l11"] == "missing" and all(len(ids) <= CAPS[b] for b, ids in picks.items())
    report = {r.label: r for r in c.coverage_report(got, labels, "id", LABELS).collect()}
    assert all((report[x].n_picked > 0) == any(x in of.get(i, ()) for ids in picks.values() for i in ids) for x in LABELS) and report["l11"].n_available == 0


def test_repairs():
    """An uncovered label takes the place of the last item that isn't alone in covering one; without such, the last place."""
    items = [(0, "a", frozenset("x")), (1, "a", frozenset("y")), (2, "a", frozenset("x")), (3, "a", frozenset("z")), (4, "a", frozenset("w"))]
    assert c.walk(items, {"a": 3}, {"a": ["x", "y"]}, ["x", "y", "z"]) == ({"a": [0, 1, 3]}, {"x": "picked", "y": "picked", "z": "repair"})
    assert c.walk(items, {"a": 2}, {"a": ["x", "y"]}, ["x", "y", "w"]) == ({"a": [0, 4]}, {"x": "picked", "y": "picked", "w": "repair"})
    assert c.walk(items, {"a": 9}, {}, ["q"])[1] == {"q": "missing"} and c.walk([], {"a": 1}, {"a": ["x"]}, ["x"]) == ({"a": []}, {"x": "missing"})


def test_nothing(spark):
    none = spark.createDataFrame([], "id long, level string")
    assert c.coverage_pick(none, spark.createDataFrame([], "id long, label string"), "id", "level", CAPS, {}, LABELS).count() == 0


def test_the_walk_is_given_bounded_rows_only(spark):
    from millrace.plans import data_queries as q

    plan = q.coverage_repaired_pick(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce 1" not in plan and "SinglePartition" in plan
