"""Queries on documents, conversations and pages: contamination, duplicates, audits, splits, rendering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import leaves
from millrace.functions import text as tx
from millrace.operators import chats, coverage, selection, spans
from millrace.sources.tables import canonical_json, nonblank, table, without_fences

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SEED = 3001


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_NORM = "regexp_replace(regexp_replace({x}, '[0-9]', 'N', 'g'), '[，。！？、；：\\s\\x{{3000}}]', '', 'g')"
_DRAWN = f"md5('{SEED}|' || doc_id)"


def _lines(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key), F.explode(F.split("text", "\n")).alias("line"))


@query("""SELECT lang, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_lines FROM
  (SELECT lang, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents) GROUP BY lang""")
def scan_nonblank_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and non-blank lines by language."""
    n = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return table(spark, sf, "documents").select("lang", n.alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").cast("long").alias("n_lines"))


@query("""SELECT DISTINCT d.doc_id FROM documents d SEMI JOIN benchmark b ON sha256(d.text) = sha256(b.text)""")
def contamination_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text is a benchmark item: a semi join on digests."""
    eval_ = table(spark, sf, "benchmark").select(tx.fingerprint(F.col("text")).alias("fp")).distinct()
    return table(spark, sf, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("fp")).join(eval_, "fp", "left_semi").select("doc_id").distinct()


@query(f"""WITH l AS (SELECT doc_id, {_NORM.format(x="unnest(string_split(text, chr(10)))")} AS k FROM documents),
b AS (SELECT {_NORM.format(x="unnest(string_split(text, chr(10)))")} AS k FROM benchmark)
SELECT doc_id, count(*) AS n_lines FROM l SEMI JOIN b ON l.k = b.k WHERE length(l.k) >= 4 GROUP BY doc_id""")
def contamination_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents equal to a benchmark line in normal form, four characters at least."""
    k = tx.normalized(F.col("line")).alias("k")
    eval_ = _lines(table(spark, sf, "benchmark"), "item_id").select(k).distinct()
    lines = _lines(table(spark, sf, "documents"), "doc_id").select("doc_id", k).where(F.length("k") >= 4)
    return lines.join(eval_, "k", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("""WITH l AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS k FROM documents),
b AS (SELECT DISTINCT CASE WHEN item_id % 2 = 0 THEN 'frozen' ELSE 'diagnostic' END AS suite, trim(unnest(string_split(text, chr(10)))) AS k FROM benchmark)
SELECT suite, count(DISTINCT doc_id) AS n_docs FROM l JOIN b ON l.k = b.k WHERE l.k <> '' GROUP BY suite""")
def contamination_by_suite(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share a line with each suite."""
    suite = F.when(F.col("item_id") % 2 == 0, "frozen").otherwise("diagnostic").alias("suite")
    eval_ = table(spark, sf, "benchmark").select(suite, F.explode(F.split("text", "\n")).alias("line")).select("suite", F.trim("line").alias("k")).distinct()
    lines = _lines(table(spark, sf, "documents"), "doc_id").select("doc_id", F.trim("line").alias("k")).where("k <> ''").distinct()
    return lines.join(eval_, "k").groupBy("suite").agg(F.count_distinct("doc_id").alias("n_docs"))


@query("""SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_duplicates FROM documents""")
def duplicate_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return selection.duplicates(table(spark, sf, "documents"), tx.fingerprint(F.col("text")))


@query("""SELECT count(*) AS n_rows, count(DISTINCT (p, c)) AS n_distinct, count(*) - count(DISTINCT (p, c)) AS n_duplicates FROM
 (SELECT a.text AS p, b.text AS c FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')""")
def duplicate_pairs_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated pairs of a user message and its answer."""
    t = table(spark, sf, "conversations")
    a = t.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("p"))
    b = t.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("c"))
    return selection.duplicates(a.join(b, ["conv_id", "turn"]), tx.fingerprint(F.col("p"), F.col("c")))


@query(f"""WITH s AS (SELECT text, row_number() OVER (ORDER BY {_DRAWN}, doc_id) <= greatest(1, floor(count(*) OVER () * 0.1)) AS val FROM documents)
SELECT count(*) AS n_overlap FROM (SELECT text FROM s WHERE val INTERSECT SELECT text FROM s WHERE NOT val)""")
def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Texts on both sides of the random split."""
    s = selection.random_split(table(spark, sf, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("fp")), "doc_id", 0.1, SEED)
    return selection.overlap(s.where("split = 'val'"), s.where("split = 'train'"), ["fp"])


_SKEL = f"regexp_replace({_NORM.format(x="regexp_replace(text, '[A-Za-z]+', 'x', 'g')")}, '[\\x{{4e00}}-\\x{{9fff}}]+', 'X', 'g')"


@query(f"""SELECT count(*) AS n, count(DISTINCT text) AS n_exact, count(DISTINCT {_NORM.format(x="text")}) AS n_normalized, count(DISTINCT {_SKEL}) AS n_skeletons,
  count(DISTINCT text) >= 300 AND count(DISTINCT {_NORM.format(x="text")}) >= 240 AND count(DISTINCT {_SKEL}) >= 100 AS passed FROM documents""")
def diversity_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct texts, normal forms and skeletons, and the gate 300 / 240 / 100; one shuffle of digests for each form."""
    forms = F.array(*[F.struct(F.lit(k).alias("form"), F.sha2(v, 256).alias("v")) for k, v in (("exact", F.col("text")), ("normalized", tx.normalized(F.col("text"))), ("skeletons", tx.skeleton(F.col("text"))))])
    each = table(spark, sf, "documents").select(F.explode(forms).alias("f")).groupBy("f.form", "f.v").agg(F.count(F.lit(1)).alias("n"))
    d = lambda k: F.count_if((F.col("form") == k) & F.col("v").isNotNull())
    out = each.agg(F.sum(F.when(F.col("form") == "exact", F.col("n"))).alias("n"), *[d(k).alias(f"n_{k}") for k in ("exact", "normalized", "skeletons")])
    return out.withColumn("passed", (F.col("n_exact") >= 300) & (F.col("n_normalized") >= 240) & (F.col("n_skeletons") >= 100))


@query(f"""SELECT sha256({_SKEL}) AS digest, max(length({_SKEL})) AS n_chars, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 ORDER BY n DESC, digest LIMIT 10""")
def skeleton_top_all(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most frequent skeletons of any length, by digest."""
    s = table(spark, sf, "documents").where("text IS NOT NULL").select(tx.skeleton(F.col("text")).alias("s")).select(F.sha2("s", 256).alias("digest"), F.length("s").cast("long").alias("c"))
    return s.groupBy("digest").agg(F.max("c").alias("n_chars"), F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "digest").limit(10)


@query("""WITH q(lang, quota) AS (VALUES ('en', 500), ('de', 130), ('fr', 130), ('es', 110), ('it', 10)), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT q.lang, CAST(quota AS BIGINT) AS quota, coalesce(n, 0) AS n, coalesce(n, 0) - quota AS surplus, coalesce(n, 0) >= quota AS met FROM q LEFT JOIN n ON q.lang = n.lang""")
def distribution_vs_quota(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by language against quotas; a language without documents counts zero."""
    quotas = spark.createDataFrame([("en", 500), ("de", 130), ("fr", 130), ("es", 110), ("it", 10)], "lang string, quota long")
    n = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    j = F.broadcast(quotas).join(n, "lang", "left").select("lang", "quota", F.coalesce("n", F.lit(0)).alias("n"))
    return j.withColumn("surplus", F.col("n") - F.col("quota")).withColumn("met", F.col("n") >= F.col("quota"))


@query("""WITH d AS (SELECT count(*) AS n_docs, count(*) - count(DISTINCT text) AS n_duplicates, CAST(sum(n_chars) AS BIGINT) AS n_chars, bit_xor(CAST('0x' || substr(sha256(text), 1, 15) AS BIGINT)) AS digest FROM documents),
o AS (SELECT count(*) AS n_exact_overlap FROM documents d SEMI JOIN benchmark b ON d.text = b.text), l AS (SELECT count(*) AS n_labels, CAST(sum(toxic) AS BIGINT) AS n_toxic FROM labels)
SELECT * FROM d, o, l""")
def dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """One row: counts, an order-free digest, duplicates, overlap with the benchmark, labels."""
    fp = F.sha2("text", 256)
    each = table(spark, sf, "documents").select(fp.alias("fp"), "n_chars").groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"))
    hit = table(spark, sf, "benchmark").select(fp.alias("fp")).distinct().withColumn("hit", F.lit(1))
    part = F.conv(F.substring("fp", 1, 15), 16, 10).cast("long")
    d = each.join(hit, "fp", "left").agg(
        F.sum("n").alias("n_docs"), (F.sum("n") - F.count("fp")).alias("n_duplicates"), F.sum("c").alias("n_chars"),
        F.bit_xor(F.when(F.col("n") % 2 == 1, part).otherwise(0)).alias("digest"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("n_exact_overlap"),
    )
    return d.crossJoin(table(spark, sf, "labels").agg(F.count(F.lit(1)).alias("n_labels"), F.sum("toxic").cast("long").alias("n_toxic")))  # a row by a row


@query("""SELECT coalesce(source, 'unknown') AS target, count(*) AS n FROM (SELECT source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source FROM documents WHERE doc_id % 2 = 1) GROUP BY 1""")
def target_distribution_union(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over the union of two parts."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    return d.where("doc_id % 2 = 0").unionByName(d.where("doc_id % 2 = 1")).groupBy(F.coalesce("source", F.lit("unknown")).alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_DRAWN}, doc_id) <= greatest(1, floor(count(*) OVER () * 0.1)) THEN 'val' ELSE 'train' END AS split FROM documents""")
def random_split_md5(spark: SparkSession, sf: str) -> DataFrame:
    return selection.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.1, SEED)


@query(f"""SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_DRAWN}, doc_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY lang) * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM documents""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return selection.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", 0.1, SEED)


@query(f"""WITH r AS (SELECT doc_id, source, {_DRAWN} AS d, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY {_DRAWN}, doc_id) <= 5 THEN 'quota' ELSE 'fill' END AS picked_as FROM documents)
SELECT doc_id, source, picked_as FROM r ORDER BY picked_as = 'quota' DESC, d, doc_id LIMIT 240""")
def quota_sample_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Five of each source, then others up to 240 (a sampling operator: the cap is its parameter)."""
    return selection.quota_sample(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source", 5, 240, SEED)


@query(f"""WITH d AS (SELECT *, CASE WHEN CAST('0x' || substr(md5('{SEED}|' || source), 1, 6) AS BIGINT) % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM documents)
SELECT split, count(*) AS n, count(DISTINCT source) AS n_groups, 0::BIGINT AS n_leaks FROM d GROUP BY split""")
def leakfree_group_split(spark: SparkSession, sf: str) -> DataFrame:
    """Split by source: sizes, groups, and groups found on both sides."""
    d = selection.group_split(table(spark, sf, "documents").select("doc_id", "source"), "source", 10, SEED)
    each = d.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))
    leaks = each.groupBy("source").agg(F.count(F.lit(1)).alias("sides"))
    return each.join(leaks, "source").groupBy("split").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("sides") > 1).alias("n_leaks"))


@query("""SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 2""")
def first_k_per_tag(spark: SparkSession, sf: str) -> DataFrame:
    return selection.top_by_rank(table(spark, sf, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id")], 2)


@query("""WITH c AS (SELECT d.doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 0 THEN 1 ELSE 2 END, d.doc_id) AS rank FROM documents d JOIN labels l USING (doc_id))
SELECT doc_id, lang, rank FROM c WHERE rank <= 10""")
def coverage_first_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Ten of each language, rare labels first."""
    j = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    order = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return selection.top_by_rank(j, ["lang"], [order, F.col("doc_id")], 10).select("doc_id", "lang", "rank")


@query(f"""SELECT conv_id, md5('{SEED}|' || conv_id) AS drawn FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY drawn LIMIT 10""")
def spot_sample_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Ten conversations in a seeded order."""
    return table(spark, sf, "conversations").select("conv_id").distinct().withColumn("drawn", tx.drawn(SEED, F.col("conv_id"))).orderBy("drawn").limit(10)


@query("""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last_at FROM conversations)
SELECT 'sft-' || conv_id AS id, count(*) FILTER (turn < last_at) AS n_prompt_turns, sha256(coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (turn < last_at), '')) AS prompt_sha256,
 sha256(max(text) FILTER (turn = last_at)) AS completion_sha256, length(max(text) FILTER (turn = last_at)) AS completion_chars FROM t WHERE last_at IS NOT NULL GROUP BY conv_id""")
def sft_render(spark: SparkSession, sf: str) -> DataFrame:
    return chats.render_sft(table(spark, sf, "conversations"))


@query("""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, coalesce(max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id), 1000000) AS last_at FROM conversations),
u AS (SELECT *, min(turn) FILTER (role = 'user' AND turn < last_at) OVER (PARTITION BY conv_id) AS first FROM t),
p AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn = first THEN text WHEN role = 'user' THEN '[USER_FOLLOWUP]' || chr(10) || text WHEN role = 'tool' THEN '[TOOL_RESULT]' || chr(10) || text WHEN role = 'assistant' AND text <> '' THEN '[ASSISTANT]' || chr(10) || text END AS part FROM u WHERE turn < last_at)
SELECT t.conv_id, arg_max(text, turn) FILTER (role = 'system') AS system, coalesce((SELECT string_agg(part, chr(10) || chr(10) ORDER BY p.turn) FROM p WHERE p.conv_id = t.conv_id), '') AS user, coalesce(max(text) FILTER (turn = last_at), '') AS target
FROM t GROUP BY t.conv_id""")
def sft_adapter_fold(spark: SparkSession, sf: str) -> DataFrame:
    return chats.fold(table(spark, sf, "conversations"))


@query("""WITH t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS j FROM conversations WHERE role <> 'system'),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, 'first_not_user' AS issue FROM c WHERE conv_id NOT IN (SELECT conv_id FROM t WHERE i = 1 AND role = 'user')
UNION ALL SELECT DISTINCT conv_id, 'same_role_twice' FROM t WHERE role = before
UNION ALL SELECT conv_id, 'last_not_assistant' FROM c WHERE conv_id NOT IN (SELECT conv_id FROM t WHERE j = 1 AND role = 'assistant')
UNION ALL SELECT conv_id, 'repeated_turn' FROM conversations GROUP BY conv_id HAVING count(DISTINCT turn) < count(*)""")
def message_sequence_check(spark: SparkSession, sf: str) -> DataFrame:
    return chats.order_issues(table(spark, sf, "conversations"))


@query("""SELECT CAST(count(DISTINCT conv_id) AS BIGINT) AS n_rows, count(DISTINCT conv_id) FILTER (role = 'assistant') AS n_with_target, count(*) FILTER (trim(coalesce(text, '')) = '') AS n_empty,
 count(DISTINCT conv_id) = count(DISTINCT conv_id) FILTER (role = 'assistant') AND count(*) FILTER (trim(coalesce(text, '')) = '') = 0 AS passed FROM conversations""")
def sft_preflight_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Gate before training: every conversation has a target and no message is empty."""
    each = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max((F.col("role") == "assistant").cast("int")).alias("t"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("e"))
    out = each.agg(F.count("conv_id").alias("n_rows"), F.count_if(F.col("t") == 1).alias("n_with_target"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_empty"))
    return out.withColumn("passed", (F.col("n_rows") == F.col("n_with_target")) & (F.col("n_empty") == 0))


@query("""SELECT conv_id, turn, sha256('{"content":' || to_json(text) || ',"role":' || to_json(role) || '}') AS sha256 FROM conversations""")
def prompt_canonical_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of each message's canonical JSON."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(canonical_json({"role": F.col("role"), "content": F.col("text")}), 256).alias("sha256"))


@query("""SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS calibration FROM conversations GROUP BY conv_id""")
def calibration_text(spark: SparkSession, sf: str) -> DataFrame:
    """All texts of a conversation, a line each."""
    return chats.messages(table(spark, sf, "conversations")).select("conv_id", F.array_join(F.transform("messages", lambda m: m["content"]), "\n").alias("calibration"))


@query("""SELECT page_id, count(*) AS n_lines FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS l FROM pages) WHERE trim(l) <> '' AND NOT starts_with(trim(l), '```') GROUP BY page_id""")
def generated_lines_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of generated output that are neither blank nor fences."""
    lines = table(spark, sf, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("value"))
    return without_fences(nonblank(lines)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("""SELECT page_id, starts_with(ltrim(html), '<!DOCTYPE html>') AS has_doctype, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs, contains(html, '</html>') AS closed, json_valid(html) AS is_json FROM pages""")
def markup_output_check(spark: SparkSession, sf: str) -> DataFrame:
    """Format checks on raw output."""
    return table(spark, sf, "pages").select(
        "page_id", F.ltrim("html").startswith("<!DOCTYPE html>").alias("has_doctype"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("n_paragraphs"),
        F.contains("html", F.lit("</html>")).alias("closed"), F.try_parse_json("html").isNotNull().alias("is_json"),
    )


@query(r"""WITH p AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM pages)
SELECT regexp_replace(path, '^/([a-z]+)/.*$', '\1') AS name, count(*) AS n, contains(regexp_replace(path, '^/([a-z]+)/.*$', '\1'), '/') AS unresolved FROM p GROUP BY 1""")
def registry_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Paths in normal form by the name of their first part."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    named = table(spark, sf, "pages").select(F.regexp_replace(path, "^/([a-z]+)/.*$", "$1").alias("name"))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("unresolved", F.contains("name", F.lit("/")))


@query("""SELECT page_id, list_contains(string_split(url, '/'), 'en') AS has_en, regexp_matches(lower(url), 'frozen|diagnostic|base_benchmark') AS forbidden FROM pages""")
def path_guards(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.array_contains(F.split("url", "/"), "en").alias("has_en"), F.lower("url").rlike("frozen|diagnostic|base_benchmark").alias("forbidden"))


@query(r"""SELECT lang, count(*) AS n, count(*) FILTER (NOT regexp_matches(text, '(?i)\b(the|and|with)\b')) AS n_passed FROM documents GROUP BY lang""")
def language_leak_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without English function words, by language."""
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("text").rlike(r"(?i)\b(the|and|with)\b")).alias("n_passed"))


@query(r"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN contains(text, '?') THEN 'question' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'number' END,
 CASE WHEN contains(text, chr(10)) THEN 'multiline' END, CASE WHEN length(text) < 40 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS intents FROM conversations WHERE role = 'user'""")
def intent_multilabel(spark: SparkSession, sf: str) -> DataFrame:
    """Cues of each user message."""
    t = F.col("text")
    cues = {"question": t.contains("?"), "number": t.rlike("[0-9]"), "multiline": t.contains("\n"), "short": F.length(t) < 40}
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(tx.labels(cues), ",").alias("intents"))


def _best_anchor(asked: DataFrame, items: DataFrame) -> DataFrame:
    """The most similar other item for each asked one, by the greater of both similarities of whole normal forms; equal skeletons of three characters or more raise 0.5 to 1.0."""
    forms = lambda d: d.where("text IS NOT NULL").select(
        "item_id", F.regexp_replace("text", rf"[{tx.PUNCTUATION}\s\x{{3000}}]", "").alias("t"), F.regexp_replace(F.regexp_replace("text", r"[\x{4e00}-\x{9fff}]+", "X"), "[0-9]+", "N").alias("s")
    ).withColumn("g", tx.bigrams(F.col("t")))
    j = forms(asked).alias("x").join(forms(items).alias("y"), F.col("x.item_id") != F.col("y.item_id"))
    surface = F.greatest(tx.jaccard(F.col("x.g"), F.col("y.g")), tx.levenshtein_ratio(F.col("x.t"), F.col("y.t")))
    pairs = j.select(F.col("x.item_id").alias("item_id"), F.col("y.item_id").alias("anchor_id"), surface.alias("sim"), ((F.col("x.s") == F.col("y.s")) & (F.length("x.s") >= 3)).alias("same"))
    sim = F.when(F.col("same") & (F.col("sim") >= 0.5), 1.0).otherwise(F.col("sim"))
    best = pairs.groupBy("item_id").agg(F.max(F.struct(sim.alias("sim"), (-F.col("anchor_id")).alias("a"))).alias("m"))
    return best.select("item_id", F.round("m.sim", 6).alias("similarity"), F.when(F.col("m.sim") > 0, -F.col("m.a")).alias("anchor_id"), (F.col("m.sim") <= 0.85).alias("passed"))


@query(r"""WITH b AS (SELECT item_id, regexp_replace(text, '[，。！？、；：\s\x{3000}]', '', 'g') AS t, regexp_replace(regexp_replace(text, '[\x{4e00}-\x{9fff}]+', 'X', 'g'), '[0-9]+', 'N', 'g') AS s FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT *, CASE WHEN t = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(length(t), 2)), lambda i: substr(t, i, 2))) END AS g FROM b),
p AS (SELECT x.item_id, y.item_id AS anchor_id, x.s = y.s AND length(x.s) >= 3 AS same, greatest(CASE WHEN x.t = '' AND y.t = '' THEN 1 ELSE len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))) END,
 CASE WHEN x.t = '' AND y.t = '' THEN 1 ELSE 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) END) AS surface FROM g x JOIN g y ON x.item_id % 50 = 0 AND x.item_id <> y.item_id),
r AS (SELECT item_id, anchor_id, CASE WHEN same AND surface >= 0.5 THEN 1.0::DOUBLE ELSE surface END AS sim FROM p)
SELECT item_id, round(sim, 6) AS similarity, CASE WHEN sim > 0 THEN anchor_id END AS anchor_id, sim <= 0.85 AS passed FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, anchor_id) AS k FROM r) WHERE k = 1""")
def similarity_gate_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth item against all others, whole texts: the best anchor and the 0.85 gate."""
    b = table(spark, sf, "benchmark").select("item_id", "text")
    return _best_anchor(b.where("item_id % 50 = 0"), b)


#: Vectors in a block of queries, and in a block of rows.
_QUERIES, _ROWS = 1024, 4096


def _vector_blocks(e: DataFrame, name: str, size: int) -> DataFrame:
    """Rows of up to some ``size`` ids and vectors."""
    n = max(1, -(-e.count() // size))
    return e.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct("vec_id", "e")).alias(name)).select(name)


def _nearest_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The five nearest rows of a block for each query of a block; ties by id."""

    def arrays(block: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        ids = block.values.field("vec_id").to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        return ids[order], block.values.field("e").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]

    for batch in batches:
        for left, right in zip(batch.column("q"), batch.column("x"), strict=True):
            (qi, q), (xi, x) = arrays(left), arrays(right)
            s = np.round(q @ x.T / np.sqrt((q * q).sum(axis=1)[:, None] * (x * x).sum(axis=1)), 6)
            s[qi[:, None] == xi] = -np.inf
            best = np.argsort(-s, axis=1, kind="stable")[:, :5]
            near = np.take_along_axis(s, best, axis=1)
            row, at = np.nonzero(near != -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(qi[row]), pa.array(xi[best[row, at]]), pa.array(near[row, at])], ["query_id", "vec_id", "similarity"])


@query("""WITH q AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id, round(list_dot_product(q.e::DOUBLE[], x.embedding::DOUBLE[]) / sqrt(list_dot_product(q.e::DOUBLE[], q.e::DOUBLE[]) * list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])), 6) AS similarity FROM q JOIN embeddings x ON q.vec_id <> x.vec_id)
SELECT query_id, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p) WHERE rank <= 5""")
def embedding_topk_all(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of all rows, by cosine, for every fiftieth vector: five of each block, then of all."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    q, x = _vector_blocks(e.where("vec_id % 50 = 0"), "q", _QUERIES), _vector_blocks(e, "x", _ROWS)
    near = q.crossJoin(x).mapInArrow(_nearest_in_blocks, "query_id long, vec_id long, similarity double")
    return selection.top_by_rank(near, ["query_id"], [F.col("similarity").desc(), F.col("vec_id")], 5)


@query("""SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) AS r FROM conversations) WHERE r = 1""")
def first_row_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The first row in order (a limit is the operator)."""
    return table(spark, sf, "conversations").select("conv_id", "turn", "role").orderBy("conv_id", "turn").limit(1)


@query("""SELECT item_id, rank, doc_id FROM (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY abs(length(b.text) - d.n_chars), d.doc_id) AS rank FROM benchmark b JOIN documents d ON b.text IS NOT NULL AND d.n_chars IS NOT NULL) WHERE rank <= 4""")
def nearest_length_all(spark: SparkSession, sf: str) -> DataFrame:
    """The four documents nearest in length for each item, of all documents.

    Four documents of a length are enough, and four lengths on either side; the distinct lengths are one row, bounded by the longest text."""
    items = table(spark, sf, "benchmark").where("text IS NOT NULL").select("item_id", F.length("text").cast("long").alias("len"))
    d = table(spark, sf, "documents").where("n_chars IS NOT NULL").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    first = selection.top_by_rank(d, ["n_chars"], [F.col("doc_id")], 4).select("doc_id", "n_chars")
    known = d.select("n_chars").distinct().agg(F.sort_array(F.collect_list("n_chars")).alias("known"))
    below, above = F.filter("known", lambda x: x <= F.col("len")), F.filter("known", lambda x: x > F.col("len"))
    near = F.concat(F.slice(F.reverse(below), 1, 4), F.slice(above, 1, 4))
    lengths = items.select("len").distinct().crossJoin(F.broadcast(known)).select("len", F.explode(near).alias("n_chars"))
    best = selection.top_by_rank(first.join(lengths, "n_chars"), ["len"], [F.abs(F.col("len") - F.col("n_chars")), F.col("doc_id")], 4)
    return items.join(best, "len").select("item_id", "rank", "doc_id")


@query("""WITH p AS (SELECT doc_id, source, lang, text FROM documents), r AS (SELECT doc_id, replace(replace(text, source, '<SOURCE_1>'), lang, '<LANG_1>') AS hidden, text FROM p)
SELECT doc_id, CAST(len(regexp_extract_all(hidden, '<[A-Z]+_[0-9]+>')) AS BIGINT) AS n_placeholders, true AS same FROM r""")
def placeholder_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Values to placeholders and back: how many, and whether the text is whole again."""
    hidden = F.replace(F.replace("text", F.col("source"), F.lit("<SOURCE_1>")), F.col("lang"), F.lit("<LANG_1>"))
    d = table(spark, sf, "documents").withColumn("hidden", hidden)
    back = tx.restored(F.col("hidden"), F.create_map(F.lit("<SOURCE_1>"), F.col("source"), F.lit("<LANG_1>"), F.col("lang")))
    return d.select("doc_id", F.size(tx.placeholders(F.col("hidden"))).cast("long").alias("n_placeholders"), (back == F.col("text")).alias("same"))


_W = "[A-Za-z]{5,}"
_VALUES_SQL = f"""WITH f AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations GROUP BY conv_id),
v AS (SELECT DISTINCT conv_id, v, CASE WHEN contains(v, ' ') THEN 'PAIR' WHEN length(v) > 7 THEN 'LONG' ELSE 'WORD' END AS kind FROM (SELECT conv_id, unnest(list_concat(regexp_extract_all(t, '{_W}'), regexp_extract_all(t, '{_W} {_W}'))) AS v FROM f)),
c AS (SELECT x.conv_id, x.turn, i AS s, i + length(v) AS e, v, kind FROM conversations x JOIN v ON v.conv_id = x.conv_id, unnest(range(1, length(x.text) - length(v) + 2)) u(i) WHERE substr(x.text, i, length(v)) = v),
l AS (SELECT conv_id, turn, list([{{'s': s, 'e': e, 'v': v, 'kind': kind}}] ORDER BY e - s DESC, s) AS l FROM c GROUP BY ALL),
g AS (SELECT conv_id, turn, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN a ELSE list_concat(a, x) END), recursive := true) FROM l),
n AS (SELECT *, '<' || kind || '_' || row_number() OVER (PARTITION BY conv_id, turn, kind ORDER BY s) || '>' AS token, coalesce(lag(e) OVER (PARTITION BY conv_id, turn ORDER BY s), 1) AS was FROM g)"""


@query(_VALUES_SQL + """, h AS (SELECT conv_id, turn, string_agg(substr(x.text, was, s - was) || token, '' ORDER BY s) AS head, max(e) AS last, count(*) AS k, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM n JOIN conversations x USING (conv_id, turn) GROUP BY ALL),
r AS (SELECT x.conv_id, x.turn, coalesce(k, 0) AS n_spans, coalesce(kinds, '') AS kinds, coalesce(head, '') || substr(x.text, coalesce(last, 1)) AS hidden FROM conversations x LEFT JOIN h ON h.conv_id = x.conv_id AND h.turn = x.turn)
SELECT *, regexp_replace(hidden, '<[A-Z]+_[0-9]+>', '某', 'g') AS marked FROM r""")
def placeholder_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Words and pairs of words of a conversation's first turn hidden in all its turns, longest first, and each token as one mark."""
    t = table(spark, sf, "conversations")
    first = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    found = F.concat(*[F.regexp_extract_all("first", F.lit(p), F.lit(0)) for p in (_W, f"{_W} {_W}")])
    values = F.transform(F.array_distinct(found), lambda v: F.struct(v.alias("value"), F.when(v.contains(" "), "PAIR").when(F.length(v) > 7, "LONG").otherwise("WORD").alias("type")))
    h = t.join(first.select("conv_id", values.alias("values")), "conv_id").withColumn("h", spans.hide(F.col("text"), F.col("values")))
    kinds = F.array_join(F.map_keys(spans.token_counts(F.col("h.hidden"))), ",")
    return h.select("conv_id", "turn", F.size("h.spans").cast("long").alias("n_spans"), kinds.alias("kinds"), "h.hidden", spans.marked(F.col("h.hidden")).alias("marked"))


#: Caps of languages, labels each prefers, and labels that must be covered somewhere (a report of a few picks is the operator).
_CAPS = {"en": 8, "de": 9, "es": 8, "fr": 5}
_MUST = ("toxic", "poor", "good", "short", "long", "s0", "s1", "s2", "s3", "s4", "s5")


@query()
def coverage_repaired_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each language that cover quality labels, lengths and kinds of sources first, with repairs; the walk isn't expressible in SQL."""
    d = table(spark, sf, "documents")
    judged = d.select("doc_id").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "poor"), F.when(F.col("quality") == 1, "good")))).alias("label"))
    kind = F.concat(F.lit("s"), F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(6)).cast("string"))
    own = d.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.length("text") < 200, "short"), F.when(F.length("text") > 20000, "long"), kind))).alias("label"))
    return coverage.coverage_pick(d, judged.union(own), "doc_id", "lang", _CAPS, {b: list(_MUST[i::2]) for i, b in enumerate(_CAPS)}, list(_MUST))


@query("""WITH t AS (SELECT conv_id, list({'role': role, 'content': text, 'more': {'tags': [role, NULL, ' '], 'n': turn}} ORDER BY turn) AS turns FROM conversations GROUP BY conv_id),
j AS (SELECT conv_id, to_json({'id': 'c' || conv_id, 'turns': turns}) AS j FROM t), s AS (SELECT conv_id, x.id, regexp_replace(x.atom ->> '$', '^\\s+|\\s+$', '', 'g') AS v FROM j, json_tree(j.j) x WHERE x.type = 'VARCHAR')
SELECT conv_id, string_agg(v, chr(10) ORDER BY id) AS line FROM s WHERE v <> '' GROUP BY conv_id""")
def calibration_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """All texts at any depth of a conversation's nested JSON, a line each, in the order of the document."""
    turn = F.struct("turn", "role", F.col("text").alias("content"), F.struct(F.array("role", F.lit(None).cast("string"), F.lit(" ")).alias("tags"), F.col("turn").alias("n")).alias("more"))
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.transform("turns", lambda x: x.dropFields("turn")).alias("turns")))
    return t.select("conv_id", leaves.calibration_line(whole).alias("line"))
