"""Every query of the engine against its SQL on the smallest tables, and properties that hold for any input."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.functions import dates
from millrace.functions import text as tx
from millrace.operators import chats, reports, selection
from millrace.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(table):
    value = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted(repr([value(r[c]) for c in sorted(r)]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toArrow(), con.sql(catalog.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert plain(got) == plain(want)


#: Queries that SQL can't express; each is tested against a plain version.
WITHOUT_SQL = {"coverage_repaired_pick"}


def test_every_query_has_sql(spark):
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) | WITHOUT_SQL
    assert all(catalog.QUERIES[name](spark, SF).count() for name in WITHOUT_SQL)


def test_splits(spark):
    df = spark.createDataFrame([(i, f"g{i % 7}" if i % 5 else None) for i in range(500)], "id long, g string")
    a = selection.random_split(df, "id", 0.1, 1).collect()
    assert sorted(map(str, a)) == sorted(map(str, selection.random_split(df.repartition(3), "id", 0.1, 1).collect()))
    assert len(a) == 500 and sum(r.split == "val" for r in a) == 50
    s = selection.stratified_split(df, "id", "g", 0.1, 1).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "val").alias("v")).collect()
    assert sum(r.n for r in s) == 500 and all(r.v == max(1, round(r.n * 0.1)) for r in s)
    assert selection.random_split(df.limit(0), "id", 0.1, 1).count() == 0


def test_text(spark):
    row = spark.range(1).select(
        tx.jaccard(tx.bigrams(F.lit("abc")), tx.bigrams(F.lit("bcd"))).alias("j"), tx.jaccard(tx.bigrams(F.lit("")), tx.bigrams(F.lit(""))).alias("e"), tx.levenshtein_ratio(F.lit("kitten"), F.lit("sitting")).alias("l"),
        tx.normalized(F.lit("共 12 人，好。")).alias("n"), tx.skeleton(F.lit("abc共人12")).alias("s"), tx.restored(F.lit("<A_1> <A_12>"), F.create_map(F.lit("<A_1>"), F.lit("x"), F.lit("<A_12>"), F.lit("y"))).alias("r"),
        tx.same_placeholders(F.lit("<A_1><B_2>"), F.lit("<B_2> <A_1> <A_1>")).alias("p"), dates.is_calendar_day(F.lit("2026-02-30")).alias("d"), dates.is_calendar_day(F.lit("2026-2-3")).alias("d2"),
    ).first()
    assert (row.j, row.e, round(row.l, 4), row.n, row.s, row.r, row.p, row.d, row.d2) == (1 / 3, 1.0, round(1 - 3 / 7, 4), "共NN人好", "xXN" + "N", "x y", True, False, False)


def test_fold_without_assistant(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", None), (2, 0, "user", "q"), (2, 1, "assistant", ""), (2, 2, "tool", "t"), (2, 3, "assistant", "z"), (2, 4, "user", "late")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r) for r in chats.fold(turns).collect()}
    assert got == {1: (1, "s", "a\n\n[USER_FOLLOWUP]\n", ""), 2: (2, None, "q\n\n[TOOL_RESULT]\nt", "z")}


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, t string")
    tables.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(tables.read_jsonl(spark, str(tmp_path / "out"), "id long, t string").collect()) == sorted(df.collect())
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\n")
    r = tables.file_digests(spark, [str(tmp_path / "a.txt")]).first()
    import hashlib

    assert (r.name, r.sha256, r.lf_sha256) == ("a.txt", hashlib.sha256(b"x\r\ny\n").hexdigest(), hashlib.sha256(b"x\ny\n").hexdigest())


def test_latency_of_failures_only(spark):
    df = spark.createDataFrame([("a", "error", 1.0), ("b", "view", 0.0)], "run string, event_type string, value double")
    assert all(r.p95 is None and r["mean"] is None for r in reports.latency(df, ["run"]).collect())


def test_search_looks_at_all_rows(spark, con, monkeypatch):
    """Nearest vectors of other labels are found, in one block and in many."""
    import numpy as np

    from millrace.plans import data_queries

    t = con.sql("SELECT vec_id, label, embedding FROM embeddings ORDER BY vec_id").to_arrow_table().to_pydict()
    ids, e = np.array(t["vec_id"]), np.array(t["embedding"], float)
    unit = e / np.linalg.norm(e, axis=1, keepdims=True)
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        near = np.round(unit @ unit[i], 6)
        near[i] = -2
        want |= {(int(ids[i]), int(ids[j])) for j in np.lexsort((ids, -near))[:5]}
    label = dict(zip(t["vec_id"], t["label"], strict=True))
    assert any(label[a] != label[b] for a, b in want)
    for sizes in ((1024, 4096), (3, 40)):
        monkeypatch.setattr(data_queries, "_QUERIES", sizes[0])
        monkeypatch.setattr(data_queries, "_ROWS", sizes[1])
        assert {(r.query_id, r.vec_id) for r in catalog.QUERIES["embedding_topk_all"](spark, SF).collect()} == want


def test_gate_takes_whole_texts_of_all_items(spark):
    """Pairs of other last digits, alike after the head, equal skeletons, and texts with nothing in common."""
    import random
    import re

    from millrace.plans import data_queries

    rng = random.Random(4)
    said = lambda n: " ".join(rng.choice(["tea", "soup", "rice", "noon", "late", "cook", "day"]) for _ in range(n))
    tail = said(40)
    texts = {0: said(15) + tail, 3: said(15) + tail, 50: "周五晚上 6 点，两位。", 57: "周六中午 12 点，三位。", 61: "周五晚上 18 点，两位。", 100: "zzqq", 101: None, 150: "", 152: " "} | {200 + i: said(25) for i in range(1, 30)}

    def similarity(a, b):
        x, y = (re.sub(r"[，。！？、；：\s]", "", t) for t in (a, b))
        g, h = ({t[i : i + 2] for i in range(max(1, len(t) - 1))} if t else set() for t in (x, y))
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            before, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        s = max(len(g & h) / len(g | h) if g | h else 1.0, 1 - row[-1] / max(len(x), len(y)) if x or y else 1.0)
        p, q = (re.sub(r"[0-9]+", "N", re.sub("[\u4e00-\u9fff]+", "X", t)) for t in (a, b))
        return 1.0 if p == q and len(p) >= 3 and s >= 0.5 else s

    items = spark.createDataFrame(list(texts.items()), "item_id long, text string").repartition(3)
    got = {r.item_id: (r.similarity, r.anchor_id, r.passed) for r in data_queries._best_anchor(items.where("item_id % 50 = 0"), items).collect()}
    for i in (0, 50, 100, 150):
        s, a = max((similarity(texts[i], t), -k) for k, t in texts.items() if k != i and t is not None)
        assert got[i] == (round(s, 6), -a if s > 0 else None, s <= 0.85)
    assert got[0][1] == 3 and got[50][:2] == (1.0, 61) and got[100] == (0.0, None, True) and got[150][1] == 152


def test_long_skeletons_are_counted(spark, tmp_path):
    import hashlib

    long = "a 1, " * 200
    texts = [long] * 9 + ["b 2, " * 200] * 3 + ["short"] * 7 + ["共12人", None, "", ""] + ["x1 " * n for n in range(1, 15)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in catalog.QUERIES["skeleton_top_all"](spark, str(tmp_path)).collect()]
    skeleton = "xN," * 200
    assert len(got) == 10 and got[0] == (hashlib.sha256(skeleton.encode()).hexdigest(), 600, 12) and got[1][1:] == (1, 7) and got[2][1:] == (0, 2)


def test_nearest_lengths_across_blocks(spark, tmp_path):
    """Sparse lengths, lengths of many documents, ties on either side, and items far from any document."""
    docs = [(i, n) for i, n in enumerate([63, 64, 64, 64, 64, 64, 65, 10, 700, 700, 5000, 5002, None])]
    items = {1: 63, 2: 64, 3: 400, 4: 5001, 5: 1, 6: 9000, 7: 64}
    spark.createDataFrame(docs, "doc_id long, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "x" * n) for i, n in items.items()] + [(8, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {tuple(r) for r in catalog.QUERIES["nearest_length_all"](spark, str(tmp_path)).collect()}
    want = {(i, k + 1, d) for i, n in items.items() for k, (_, d) in enumerate(sorted((abs(n - c), d) for d, c in docs if c is not None)[:4])}
    assert got == want
