"""The pipeline, stage by stage: the filters against SQL on each stage's own input, mixing and sharding by their invariants."""

from collections import Counter

import duckdb

import corpus_pipeline
from millrace.llm import mixing
from millrace.llm.common import settle
from millrace.llm.oracle import OP1, OP2, OP3

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    keep = {
        "quality rules": f"SELECT doc_id FROM ({OP2}) WHERE kept",
        "near-dedup": f"SELECT doc_id FROM ({OP3}) WHERE kept",
        "decontamination": f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({OP1}))",
    }
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, SF), "test-stage")
        if name in keep:
            con.register("documents", before.toArrow())
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in con.sql(keep[name]).fetchall()), name
            assert docs.columns == columns
        elif name == "mixing":
            size = Counter()
            for r in docs.collect():
                size[r.doc_id] += len(r.text.encode().split())
            assert size == {r.doc_id: r.taken for r in mixing.plan_mix(before).collect() if r.taken}
            assert docs.columns == columns
        else:
            rows = docs.collect()
            assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in before.collect())
            total = Counter()
            for r in rows:
                total[r.shard] += r.n_bytes
            assert all(r.shard_bytes == total[r.shard] <= corpus_pipeline.SHARD_BYTES for r in rows)
