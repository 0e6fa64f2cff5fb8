"""Quotas against a sequential walk, with scarce, shared and hot sources."""

import hashlib
import random

import pytest

from millrace.operators import quotas

KINDS = ["a", "b", "c", "d"]


def drawn(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


def walk(pairs, kinds, val, train, per_source, seed):
    """Kind after kind takes its first free sources, then fills its training from the others."""
    out, held = [], set()
    of = lambda kind: {s: sorted((p for p, s2, k in pairs if k == kind and s2 == s), key=lambda p: (drawn(seed, p), p)) for _, s, k in pairs if k == kind}
    order = lambda kind, sources: sorted(sources, key=lambda s: (drawn(seed, f"{kind}|{s}"), s))
    for kind in kinds:
        mine = of(kind)
        for s in [s for s in order(kind, mine) if s not in held][:val]:
            held.add(s)
            out.append((mine[s][0], s, kind, "val"))
    for kind in kinds:
        mine = of(kind)
        rest = [(p, s) for s in order(kind, mine) if s not in held for p in mine[s][:per_source]]
        out += [(p, s, kind, "train") for p, s in rest[:train]]
    return sorted(out)


@pytest.mark.parametrize(("n_sources", "val", "train"), [(40, 3, 12), (7, 3, 12), (300, 20, 30), (2, 1, 5)])
def test_quotas_as_by_a_walk(spark, n_sources, val, train):
    rng = random.Random(n_sources)
    pairs = set()
    for i in range(600):
        source = 0 if rng.random() < 0.4 else rng.randrange(n_sources)  # one source has more than a third of all pairs
        pairs.add((f"p{i}", source, rng.choice(KINDS[: 3 if source % 5 else 4])))
    rows = [*pairs, next(iter(pairs)), ("p", None, "a"), (None, 1, "a"), ("q", 1, "other"), ("q", 1, None)]
    df = spark.createDataFrame(rows, "pair string, source long, kind string").repartition(3)
    got = quotas.quota_split(df, KINDS, val, train, 2, 5)
    assert sorted(map(tuple, got.collect())) == walk(pairs, KINDS, val, train, 2, 5)
    report = quotas.quota_report(got, KINDS, val, train).collect()
    assert len(report) == 8 and all(r.n_leaks == 0 and r.short == r.wanted - r.got >= 0 for r in report)
    assert sum(r.got for r in report) == got.count()
    if n_sources == 7:
        assert any(r.short for r in report)


def test_quotas_of_nothing(spark):
    none = spark.createDataFrame([], "pair string, source long, kind string")
    got = quotas.quota_split(none, KINDS, 3, 9, 2, 5)
    assert got.count() == 0 and {(r.got, r.short) for r in quotas.quota_report(got, KINDS, 3, 9).collect()} == {(0, 3), (0, 9)}


def test_leaks_are_seen(spark):
    split = spark.createDataFrame([("p", 1, "a", "val"), ("q", 1, "b", "train"), ("r", 2, "b", "train")], "pair string, source long, kind string, split string")
    assert {(r.kind, r.split): r.n_leaks for r in quotas.quota_report(split, ["a", "b"], 1, 2).collect()} == {("a", "val"): 1, ("a", "train"): 0, ("b", "val"): 0, ("b", "train"): 1}
