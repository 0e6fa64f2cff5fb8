"""Stages of the pipeline on awkward tables, and the directory of shards against one built bit by bit."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import sharding
from millrace.llm.common import settle

KIND = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
FILTERS = ("quality rules", "near-dedup", "decontamination")


def prose(rng, n):
    return " ".join(rng.choice([f"w{i}" for i in range(500)]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    good = [(i, prose(rng, rng.randint(60, 150)), rng.choice(("en", "de", None)), rng.choice(("a", "b", None)), None) for i in range(40)]
    return [*good, good[3], good[3], (50, good[5][1], "en", "a", 1), (None, good[6][1], "en", "a", 1), (None, None, None, None, None), (51, None, "en", "a", 0), (52, "", "en", "a", 0), (53, " \n\t", None, None, 3), (54, prose(rng, 60_000), "en", "b", 9), (50, "short", "en", "a", 1)]


def runs(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, SF), "test-stage")
        yield name, docs, out
        docs = out


def test_awkward_tables(spark, rows):
    """Nulls in any column, empty and very long texts, repeated rows and keys: filters keep rows whole, mixing and sharding lose none."""
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    for name, before, after in runs(spark, docs):
        had, has = [tuple(r)[:5] for r in before.select(docs.columns).collect()], [tuple(r)[:5] for r in after.select(docs.columns).collect()]
        if name in FILTERS:
            assert after.columns == docs.columns and all(has.count(r) <= had.count(r) for r in set(has)) and set(has) <= set(had), name
        if name == "quality rules":
            assert all(r[1] and len(r[1].split()) >= 50 for r in has) and has.count(tuple(rows[3])) == 3 and {r[0] for r in rows[:40]} <= {r[0] for r in has} and 54 in {r[0] for r in has}
        if name == "near-dedup":
            assert has.count(tuple(rows[3])) == 3 and 50 not in {r[0] for r in has} and sum(r[0] is None for r in has) == 1
        if name == "mixing":
            assert {r[0] for r in has} <= {r[0] for r in had} and all(r[1].strip() for r in has)
        if name == "sharding":
            assert sorted(map(repr, has)) == sorted(map(repr, had)) and after.where("shard IS NULL OR shard_bytes > 16777216").count() == 0


def test_clashing_columns(spark, rows):
    """Columns named as the stages' own: the filters and the mix keep them, sharding replaces those that are its result."""
    names = ("kept", "row", "m", "doc", "item", "s", "_key", "node", "band", "copy", "shard", "hash", "n_bytes", "size", "taken", "target", "block", "leaf")
    docs = spark.createDataFrame(rows[:44], KIND).withColumns({c: F.lit(c) for c in names})
    plain = {name: sorted(map(repr, out.select("doc_id", "text").collect())) for name, _, out in runs(spark, docs.drop(*names)) if name in FILTERS}
    for name, _, out in runs(spark, docs):
        if name != "sharding":
            assert out.columns == docs.columns and {r.kept for r in out.select("kept").collect()} <= {"kept"}, name
        if name in FILTERS:
            assert sorted(map(repr, out.select("doc_id", "text").collect())) == plain[name], name


def test_empty_table(spark):
    docs = spark.createDataFrame([], KIND)
    for name, _, out in runs(spark, docs):
        assert out.count() == 0 and (name == "sharding" or out.columns == docs.columns)


def split(rows, limit, bits=""):
    """Shards by halving: rows (code as 60 bits, bytes) to names."""
    if sum(b for _, b in rows) <= limit or len(rows) == 1 or len(bits) == sharding.BITS:
        return dict.fromkeys((c for c, _ in rows), bits)
    out = {}
    for bit in "01":
        if part := [r for r in rows if r[0][len(bits)] == bit]:
            out |= split(part, limit, bits + bit)
    return out


@pytest.mark.parametrize("limit", [200, 3000, 10_000_000])
def test_directory_of_shards(spark, rows, limit):
    rng = random.Random(limit)
    many = [(i, "x" * rng.choice((0, 1, 40, 90, 400)), "en", "a", i) for i in range(400)] + [(9, "same text " * 5, "en", "a", 0)] * 150
    got = sharding.assign(spark.createDataFrame([*rows[:50], *many], KIND).repartition(4), limit).collect()
    code = lambda r: f"{int(hashlib.md5(f'{r.hash}:{r.copy}'.encode()).hexdigest()[:15], 16):060b}"
    want = split([(code(r), r.n_bytes) for r in got], limit)
    assert len(got) == len(rows[:50]) + len(many) and all(r.shard == want[code(r)] and r.depth == len(r.shard) for r in got)
    total = {}
    for r in got:
        total[r.shard] = total.get(r.shard, 0) + r.n_bytes
    assert all(r.shard_bytes == total[r.shard] and r.oversized == (total[r.shard] > limit) for r in got)
