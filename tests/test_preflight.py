"""The gate before training on small files."""

import gzip
import hashlib
import json
import re

from pyspark.sql import functions as F

from millrace.operators import booking_shapes as b
from millrace.operators import preflight
from millrace.sources import checked


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row(i, **change):
    return {"id": f"dpo-{i}-H1", "raw_id": str(i), "dataset_version": "v", "heuristic": "H1", "prompt": [{"role": "user", "content": "hi"}], "chosen": "a", "rejected": "b", "chosen_sha256": sha("a"), "rejected_sha256": sha("b")} | change


def read(spark, path):
    rows = preflight.forbid_ids(checked.read_checked(spark, str(path), b.DPO_ROW))
    return checked.with_duplicates(preflight.check_digests(rows, {"chosen_sha256": "chosen", "rejected_sha256": "rejected"}), "id")


def test_gate(spark, tmp_path):
    rows = [row(0), row(1, id="dpo-FROZEN-1"), row(2, chosen_sha256=sha("x")), row(3, tags="a"), row(0), row(4, rejected_sha256="short"), {"id": "Phase02"}, row(5, tags=[])]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{\n\n")
    checked_rows = read(spark, tmp_path / "a.jsonl")
    got = {(r.path, r.issue): r.n for r in preflight.by_issue(checked_rows).collect()}
    missing = {(f"$.{k}", "missing"): 1 for k in row(0) if k != "id"}
    assert got == {("$.id", "forbidden"): 1, ("$.chosen_sha256", "digest"): 1, ("$.tags", "type"): 1, ("$.id", "duplicate"): 1, ("$.rejected_sha256", "value"): 1, ("$", "json"): 1} | missing
    verdict = preflight.write_gated(checked_rows, str(tmp_path / "sound"), 8)
    assert (verdict.n_rows, verdict.n_bad, verdict.passed) == (9, 7, False) and verdict.errors == ["7 rows with faults", "9 rows, 8 expected"]
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "sound")).collect()) == ["dpo-0-H1", "dpo-5-H1"]
    assert tuple(preflight.report(checked_rows, F.lit(9)).first()) == (9, 9, 7, 6 + len(missing), False)


def test_sound_and_empty_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(row(i)) for i in range(5)))
    (tmp_path / "b.jsonl").write_text("\n")
    assert tuple(preflight.report(read(spark, tmp_path / "a.jsonl"), F.lit(5)).first()) == (5, 5, 0, 0, True)
    assert preflight.write_gated(read(spark, tmp_path / "a.jsonl"), str(tmp_path / "out"), 5).passed
    assert tuple(preflight.report(read(spark, tmp_path / "b.jsonl"), F.lit(5)).first()) == (0, 5, 0, 0, False)


def test_files_of_pairs_hold_many_orders(spark):
    from millrace.plans import structure_queries as q

    # a file of 500 orders made their number grow with the input: three files here
    assert q._dpo_lines(spark, "/root/testdata/sf0.001").select("file").distinct().count() == 1


def test_files_of_pairs_are_small(spark, tmp_path, monkeypatch):
    from millrace.plans import structure_queries as q

    monkeypatch.setattr(q, "new_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(q, "_PART", 400)
    rows = q._dpo_lines(spark, "/root/testdata/sf0.001")
    # they took 1,640 bytes an order when they were plain
    files = sorted(tmp_path.glob("pairs/part=*/part-*"))
    assert sum(f.stat().st_size for f in files) < 250 * 1500
    # each file has a run of ids, in order
    ids = [[int(x) for x in re.findall(r'"raw_id":"r(\d+)"', gzip.decompress(f.read_bytes()).decode())] for f in files]
    assert [len(x) for x in ids] == [400, 400, 400, 300] and sum(ids, []) == list(range(1500))
    assert rows.count() == 1500


def spoilt_files(path):
    """Two files with repeats within and across them; the first of some is bad, the first of others sound."""
    one = [row(0), row(0), row(1, tags="a"), row(1), "{", "{", "", {"n": 1}, {"n": 1}, {"id": None}, {"id": None}, row(2)]
    two = [row(2, tags="a"), row(0), row(3), row(1, chosen_sha256=sha("x")), row(4, id="dpo-FROZEN"), row(4, id="dpo-FROZEN")]
    for name, rows in (("a", one), ("b", two)):
        (path / f"{name}.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return 11 + 6


def placed(spark, path):
    rows = preflight.forbid_ids(checked.read_placed(spark, str(path), b.DPO_ROW))
    return preflight.check_digests(rows, {"chosen_sha256": "chosen", "rejected_sha256": "rejected"})


def test_repeats_counted_by_value(spark, tmp_path):
    spoilt_files(tmp_path)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1001")
    try:
        assert placed(spark, tmp_path).rdd.getNumPartitions() > 3
        want = sorted(map(tuple, preflight.by_issue(read(spark, tmp_path)).collect()))
        counted = preflight.by_issue(placed(spark, tmp_path), "id")
        assert sorted(map(tuple, counted.collect())) == want and ("$.id", "duplicate", 6) in want
        assert sorted(map(tuple, preflight.by_issue(checked.with_duplicates(placed(spark, tmp_path), "id")).collect())) == want
        # the files are read once, and no line is joined to anything
        plan = counted._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        assert plan.count("FileScan text") == 1 and "Join" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_report_counts_repeats_by_value(spark, tmp_path):
    n = spoilt_files(tmp_path)
    want = tuple(preflight.report(read(spark, tmp_path), F.lit(n)).first())
    reported = preflight.report(placed(spark, tmp_path), F.lit(n), "id")
    # sound are the first of 0, 2 and 3; that of 1 is bad, so all of it are
    assert tuple(reported.collect()[0]) == want and want[:3] == (n, n, n - 3)
    plan = reported._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("FileScan text") == 1 and "Join" not in plan
    nothing = tmp_path / "nothing"
    nothing.mkdir()
    (nothing / "a.jsonl").write_text("\n")
    assert tuple(preflight.report(placed(spark, nothing), F.lit(0), "id").first()) == (0, 0, 0, 0, True)
