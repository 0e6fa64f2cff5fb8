"""Each operator against a brute-force version or an exact round trip, on texts with nulls, blanks, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat_format, decontaminate, lm_score, mixing, near_dedup, quality, repeats, sharding, token_counts, url_filter
from millrace.llm.components import connected_components

WORDS = [f"w{i}" for i in range(400)]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Unique texts, exact and near copies, a shared passage, nulls, blanks and a long text."""
    rng = random.Random(1)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(30)]
    passage = prose(rng, 90)
    texts = list(base)
    for i in range(12):
        words = base[i].split()
        for _ in range(1 + i % 4):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [base[0], base[0].upper(), base[3], None, "", " \n\t ", "one two", "one  two", "ONE two", prose(rng, 8000), "é" * 250, "aaaa " * 120]
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(5)]
    out = [(i, t, "en" if i % 3 else None, ("a", "b", None)[i % 3], 0) for i, t in enumerate(texts)]
    return [*out, out[1], out[1]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


def empty(spark):
    return spark.createDataFrame([], KIND)


def wordlist(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = wordlist(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(nodes, links):
    at = {n: n for n in nodes}

    def root(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return {n: root(n) for n in nodes}


def test_near_duplicates(spark, rows, docs):
    sets = {i: shingles(t) for i, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = near_dedup.near_duplicates(docs.withColumn("node", F.lit(1))).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()}
    assert kept == {i for i in sets if want[i] == i}


def test_near_duplicates_by_rounds(spark):
    """A chain of drifting copies is one component though its ends differ, and one key with two texts joins both."""
    rng = random.Random(2)
    words = prose(rng, 120).split()
    rows = []
    for i in range(60):
        words[(i * 2) % 120] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(100, "alone in this"), (100, prose(rng, 50)), (101, "alone in this"), (None, "alone in this"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a in ids for b in ids if a < b and any(x and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])]
    want = components(ids, links)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert {k: v for k, v in got.items() if k is not None} == want
    assert got[None] is None


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 400])
def test_near_duplicates_in_families(spark, monkeypatch, block):
    """Copies at the threshold: their bands stay open after the hubs, and the family is held block by block."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(13)
    base = [prose(rng, 120).split() for _ in range(2)]
    rows = []
    for i in range(90):
        words = list(base[i % 2])
        for p in rng.sample(range(0, 120, 6), 1 + i % 5):
            words[p] = f"new{rng.randrange(4)}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    want = components(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 2 < len(set(want.values())) < 60


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(0, i) for i in range(300, 360)] + [(400 + i, 401 + i) for i in range(40)]
    want = components({x for e in links for x in e}, links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n != c}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                hit[i : i + window] = b"\1" * window
        out.append((sum(hit), len(re.findall(rb"\x01+", bytes(hit))), bytes(c for c, h in zip(t, hit, strict=True) if not h)))
    return out


def test_repeats(spark, rows):
    rng = random.Random(4)
    base = prose(rng, 300)
    more = [base[:700], base[200:900] + "x", "y" + base[350:700], base[100:299] + "z", base[100:300] + "q", prose(rng, 50) + base[500:701] + prose(rng, 40), base[500:700], "ab" * 300, "Ä" + base[400:1000]]
    every = [(*r[:2],) for r in rows] + [(1000 + i, t) for i, t in enumerate(more)]
    want = brute_repeats([(t or "").encode() for _, t in every], 200)
    got = repeats.remove_repeats(spark.createDataFrame([(i, t, 5) for i, t in every], "doc_id long, text string, size long")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted((i, len((t or "").encode()), *w) for (i, t), w in zip(every, want, strict=True))
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_repeats_in_pieces(spark):
    """A text longer than a piece: the passage lies across a piece's end."""
    rng = random.Random(5)
    long = " ".join(f"{rng.random():.9f}" for _ in range(100_000))
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame([(1, long), (2, long[1_048_000:1_049_500]), (3, long[:150])], "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed, got[3].n_removed) == (1500, 1, 1500, 0)


def test_decontaminate(spark, rows):
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate((8, 12, 40, 90, 300, 3, 30))] + [(50, None), (51, " "), (None, "x y"), (3, "short other")]
    found = [(900 + i, f"{prose(rng, 500)} {t.upper() if i % 2 else t} {prose(rng, 200)}") for i, t in items[:7]]
    part = items[3][1].split()
    found += [(950, prose(rng, 20) + " " + " ".join(part[:60])), (951, " ".join(part[:80])), (952, items[5][1]), (952, None), (None, items[2][1])]
    every = [r[:2] for r in rows] + found
    df, it = spark.createDataFrame(every, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    longest = {}
    for i, t in items:
        if i is not None and len(shingles(t)) > len(longest.get(i, ())):
            longest[i] = shingles(t)
    want = {(d, i, len(s & shingles(t)), len(s)) for d, t in every if d is not None for i, s in longest.items() if 100 * len(s & shingles(t)) >= 75 * len(s)}
    assert {tuple(r) for r in decontaminate.find_leaks(df, it).collect()} == want and len(want) > 6
    assert {r.doc_id for r in decontaminate.drop_leaks(df, it).collect()} == {d for d, _ in every} - {d for d, *_ in want}
    assert decontaminate.find_leaks(empty(spark), it).count() == decontaminate.find_leaks(df, it.limit(0)).count() == 0


def test_clashing_columns_and_empty_tables(spark, docs, rows):
    """Columns named as an operator's own or as its result's don't disturb it, and long texts are read in pieces."""
    names = ("kept", "row", "m", "_m", "t_lang", "f_repeats", "v_repeats", "_gone", "_id", "doc", "item", "s", "_key", "_s", "_row", "n_tokens", "base_failed", "copy", "shard", "hash", "n_bytes", "leaf", "code", "node", "band")
    odd = docs.withColumns({c: F.lit(c) for c in names})
    plain, clash = quality.measure(docs), quality.measure(odd)
    judged = quality.judge(clash, quality.thresholds(quality.sketch(clash)))
    assert sorted(judged.columns) == sorted({*odd.columns, *plain.columns, "kept"})
    assert sorted((r.doc_id, r.kept) for r in judged.collect()) == sorted((r.doc_id, r.kept) for r in quality.judge(plain, quality.thresholds(quality.sketch(plain))).collect())
    items = spark.createDataFrame([(1, rows[2][1])], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.drop_leaks(odd, items).collect()} == {r[0] for r in rows} - {r.doc_id for r in decontaminate.find_leaks(docs, items).collect()}
    assert decontaminate.drop_leaks(odd, items).columns == near_dedup.drop_near_duplicates(odd).columns == odd.columns
    model = lm_score.train(odd)
    assert {r.doc_id: r.n_tokens for r in lm_score.score(odd, model).collect()} == {i: len(wordlist(t)) for i, t, *_ in rows}
    assert Counter(r.doc_id for r in sharding.shard(odd, 5000).collect()) == Counter(r[0] for r in rows)
    assert lm_score.score(odd.limit(0), model).count() == decontaminate.drop_leaks(odd.limit(0), items).count() == 0


def test_very_long_texts(spark):
    """Texts of some five million characters, past every cut into pieces."""
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    rng = random.Random(16)
    long = prose(rng, 1_000_000)
    part = prose(rng, 30)
    texts = [long, f"{long} {part}", "short"]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], KIND)
    n = [len(t.split()) for t in texts]
    assert {r.doc_id: (r.n_words, r.word_chars) for r in quality.measure(df, keep_text=False).collect()} == {i: (n[i], len(t.replace(" ", ""))) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()} == {i: (len(shingles(t)), min(i, 2 * (i == 2))) for i, t in enumerate(texts)}
    assert [tuple(r)[:2] for r in decontaminate.find_leaks(df, spark.createDataFrame([(7, part)], "item_id long, text string")).collect()] == [(1, 7)]
    assert {r.doc_id: r.size for r in mixing.plan_mix(df).collect()} == dict(enumerate(n))
    tok = Tokenizer.from_file(path)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df.where("doc_id > 0"), path).collect()} == {i: len(tok.encode(texts[i], add_special_tokens=False).ids) for i in (1, 2)}
    assert {r.doc_id: r.oversized for r in sharding.shard(df, 1 << 20).collect()} == {0: True, 1: True, 2: False}
    assert {r.doc_id: r.n_tokens for r in lm_score.score(df, lm_score.train(df.where("doc_id = 2"))).collect()} == dict(enumerate(n))


def test_leaks_at_the_bound(spark):
    """Items of all sizes inside long documents, with so many words changed that their containment lies around 75 %: no leak is missed."""
    rng = random.Random(31)
    items = [(i, prose(rng, rng.choice((3, 5, 9, 20, 40, 64, 90, 150, 400)))) for i in range(60)]
    docs = []
    for i, text in items:
        for _ in range(6):
            w = text.split()
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = "changed"
            docs.append((len(docs), f"{prose(rng, rng.randint(0, 300))} {' '.join(w)} {prose(rng, rng.randint(0, 300))}"))
    want = {}
    of = [(i, shingles(t)) for i, t in items]
    for d, text in docs:
        s = shingles(text)
        want |= {(d, i): len(s & x) for i, x in of if 100 * len(s & x) >= 75 * len(x)}
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.n_shared for r in got} == want and len(want) > 100


def test_small_groups_lean_on_wider_ones(spark):
    """A fence moves from the wider group's to its own as documents come, without a step."""
    own, wider = F.lit(10), F.lit(110)
    at = [spark.range(1).select(quality._blended(F.lit(n), own, wider)).first()[0] for n in (0, 1, 50, 100, 101, 10_000)]
    assert at == [110, 109, 76, 60, 59, 10] and spark.range(1).select(quality._blended(F.lit(1), F.lit(-7), F.lit(-8))).first()[0] == -8


def test_quality_measures(spark, rows, docs):
    got = {}
    for r in quality.measure(docs).collect():
        got[r.doc_id] = r
    for i, text, *_ in rows:
        w, t = wordlist(text), text or ""
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {p + k for p in range(len(w) - 2) if grams[tuple(w[p : p + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_quality_verdicts(spark):
    rng = random.Random(7)
    good = [(i, prose(rng, rng.randint(60, 120)).capitalize() + ".", "en", "a", 0) for i in range(150)]
    junk = [(1000, " ".join(w + "$$$" for w in prose(rng, 80).split()), "en", "a", 0), (1001, prose(rng, 80).upper(), "en", "a", 0), (1002, "word", "en", "a", 0), (1003, None, None, None, 0)]
    df = spark.createDataFrame(good + junk, KIND)
    m = quality.measure(df, keep_text=False)
    verdict = {r.doc_id: r.kept for r in quality.judge(m, quality.thresholds(quality.sketch(m))).collect()}
    assert all(verdict[i] for i in range(150)) and not any(verdict[i] for i in (1000, 1001, 1002, 1003))
    m = quality.measure(empty(spark), keep_text=False)
    assert quality.judge(m, quality.thresholds(quality.sketch(m))).count() == 0


def test_bins(spark):
    values = [*range(300), 1000, 4097, 65_535, 10**9]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.to_bin(F.col("v")).alias("b"), quality.from_bin(quality.to_bin(F.col("v"))).alias("low")).collect()
    assert all(r.low <= r.v <= r.low * 33 // 32 + 1 for r in got)
    assert [r.b for r in got] == sorted(r.b for r in got)


def test_mixing(spark, rows):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice([0, 3, 40, 400])), "en", ("a", "b", "c", None, "a", "a")[i % 6], 0) for i in range(400)] + [(1, prose(rng, 9), "en", "a", 0), (2, None, None, "d", 0), (None, "x y", None, "d", 0)]
    df = spark.createDataFrame(rows, KIND)
    got = mixing.plan_mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.plan_mix(df.repartition(5)).collect()))
    sizes, target, taken = Counter(), {}, Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, level, goal = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), {}
    open_ = set(names)
    while True:
        share = {s: level * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = 2.0 * sizes[s]
        level -= sum(goal[s] for s in over)
        open_ -= over
        if not open_:
            break
    for s in names:
        assert target[s] == pytest.approx(goal[s]) and abs(taken[s] - goal[s]) <= max(130, 0.02 * goal[s]), s
    some = df.where("doc_id > 2").withColumns({c: F.lit(1) for c in ("_key", "_cut", "_size", "of", "size", "cut", "row")})
    mixed, by_id, text = mixing.mix(some), Counter(), {r[0]: r[1] for r in rows}
    assert mixed.columns == some.columns
    for r in mixed.collect():
        by_id[r.doc_id] += len(wordlist(r.text))
        assert f" {' '.join(wordlist(r.text))} " in f" {' '.join(wordlist(text[r.doc_id]))} "
    assert by_id == {r.doc_id: r.taken for r in mixing.plan_mix(some).collect() if r.taken} and by_id
    assert mixing.plan_mix(empty(spark)).count() == 0


def test_apportion(spark):
    """Seats against highest quotients taken one at a time; ties by order."""
    rng = random.Random(15)
    rows = [(g, i, float(rng.choice([0, 1, 1, 5, 30, 1000 * rng.random()])), (0, 1, 7, 40, 300)[g % 5]) for g in range(30) for i in range(1 + g % 9)]
    got = {(r.g, r.i): r.quota for r in mixing.apportion(spark.createDataFrame(rows, "g int, i int, w double, seats long"), ["g"], "w", "seats", ["i"]).collect()}
    for g in range(30):
        weight, won = {i: w for k, i, w, _ in rows if k == g and w}, Counter()
        for _ in range(next(s for k, _, _, s in rows if k == g) if weight else 0):
            won[max(weight, key=lambda i: (weight[i] / (2 * won[i] + 1), -i))] += 1
        assert {i: n for (k, i), n in got.items() if k == g} == {i: won[i] for k, i, *_ in rows if k == g}


def test_token_counts(spark, rows):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    odd = ["<|endoftext|>a<|endoftext|>", "it's  we'll 'S\u00a0\u3000x\u2028y\u180e\ufeff z\u200b", "日本語 テスト १२३ ½ Ⅷ", "a\r\n\n b\x1c\x1d\x85c\x0b", "👩‍👩‍👧 e\u0301", "  lead trail  ", "x" * 5000, "\t\t\n", "don't'll", "<|endoftext|", "ſ's ǅ"]
    rng = random.Random(9)
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3100), rng.randrange(0x9, 0x21)])) for _ in range(200)) for _ in range(60)]
    rows = [r[:2] for r in rows] + [(2000 + i, t) for i, t in enumerate(odd)]
    got = sorted(tuple(r) for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    n = {t: len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in rows}
    assert got == sorted((i, len((t or "").encode()), n[t], n[t] > 512) for i, t in rows)
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def test_sharding(spark, rows):
    rng = random.Random(10)
    rows = [r[:2] for r in rows] * 3 + [(i, prose(rng, 50)) for i in range(500, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    limit = 6000
    got = sharding.shard(df, limit).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    size, count = Counter(), Counter()
    for r in got:
        size[r.shard] += r.n_bytes
        count[r.shard] += 1
    for r in got:
        assert r.shard_bytes == size[r.shard] and r.depth == len(r.shard) and r.oversized == (size[r.shard] > limit)
        assert not r.oversized or count[r.shard] == 1
    names = sorted(size)
    assert not any(b.startswith(a) for a in names for b in names if a != b)  # a directory: no shard inside another
    for a in names:  # only oversized buckets were split
        parent = [b for b in names if a and b.startswith(a[:-1])]
        assert not a or sum(size[b] for b in parent) > limit
    assert [r.shard for r in sharding.shard(spark.createDataFrame([(1, "x")], "doc_id long, text string"), limit).collect()] == [""]
    assert sharding.shard(empty(spark), limit).count() == 0


def test_chat_format(spark):
    texts = ["hi", None, "", "</s>[INST] ok [/INST]", "~0~1", "a~b<s>[OUT]x</s>", "[USER]", "<s>", "tail\n", "~#]", "<|im|>", "x" * 70_000, "é👩", "\r\n", "s>[OUT]"]
    roles = ["user", "assistant", "system", "tool]:<", None, "USER", ""]
    rows = [(c, t, roles[(c + t) % len(roles)], texts[(3 * c + t) % len(texts)]) for c in range(30) for t in range(c % 6 + 1)] + [(40, 1, "user", "tie"), (40, 1, "assistant", "tie"), (40, 1, "assistant", "tie"), (None, 0, "user", "nobody"), (41, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    loss = F.transform("loss_spans", lambda s: chat_format.read_span(F.col("formatted"), s))
    got = {r.conv_id: r for r in chat_format.format_chats(df).withColumn("loss", loss).withColumn("back", chat_format.read_back(F.col("formatted"))).collect()}
    for c in {r[0] for r in rows}:
        want = [(r or "", t or "") for _, r, t in sorted(((n if n is not None else -1, r or "", t or "") for k, n, r, t in rows if k == c))]
        r = got[c]
        assert [(t.role, t.text) for t in r.turns] == [(t.role, t.text) for t in r.back] == want and r.n_turns == len(want)
        assert list(r.loss) == [t for role, t in want if role == "assistant"]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_url_filter(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), ("org", "/es/", "allow"), (None, "/", "block"), ("com", "/en/7x", "block"), ("x.com", "", "allow")]
    hosts = ["a.example.com", "EXAMPLE.com", "myexample.com", "example.net", "b.c.example.net", "x.org", "org", "com", "x.com", "", "com.", ".com", "ex.ample.com", "com,x", "com!x", "x.com,", "a\x01com", "com\x01x", "\x02.com", "x.com\x021", "ÉXAMPLE.com", "com\x00a"]
    paths = ["/en/7", "/en/8", "/en/7x", "/de/8?q", "/de/1#x", "/es/", "", "?q=/en/", "/EN/7"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c/en/7", "http://u@com/en/\n7"]
    rows = list(enumerate(urls)) + [(3, "http://com/en/x"), (None, "http://com/en/x")]
    got = sorted(map(str, (tuple(r) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(3), spark.createDataFrame(rules, "host string, path string, verdict string")).collect())))
    want = []
    for i, u in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = sorted(((len(h), len(p), v), h + p, v) for h, p, v in [*rules[:5], ("org", "/es/", "allow"), *rules[7:]] if host and (host == h or host.endswith("." + h)) and path.startswith(p))
        best = max(fit, key=lambda x: (x[0][:2], x[0][2] == "allow")) if fit else None
        want.append(str((i, host, path, best[1] if best else None, best[2] if best else "allow")))
    assert got == sorted(want)
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_lm_score(spark):
    """Held-out texts of the language that was learned score better than the same words in any order."""
    rng = random.Random(11)
    chain = {w: rng.sample(WORDS[:60], 3) for w in WORDS[:60]}

    def said(n):
        out = [WORDS[0]]
        while len(out) < n:
            out.append(rng.choice(chain[out[-1]]))
        return out

    learn = spark.createDataFrame([(i, " ".join(said(400))) for i in range(150)] + [(1, None), (2, "")], "doc_id long, text string")
    model = lm_score.train(learn)
    held = [said(200) for _ in range(20)]
    mixed = [rng.sample(h, len(h)) for h in held]
    rows = [(i, " ".join(t)) for i, t in enumerate(held + mixed)] + [(100, None), (101, " "), (102, "one")]
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[i].mean_log_prob > got[i + 20].mean_log_prob for i in range(20))
    assert (got[100].n_tokens, got[100].log_prob, got[100].mean_log_prob) == (0, 0.0, None) and got[102].n_tokens == 1
    assert lm_score.score(empty(spark), lm_score.train(empty(spark))).count() == 0


class _Sent:
    def __init__(self, value):
        self.value = value


def test_lm_trains_on_every_place():
    """All rounds together see each place of each text once, in texts of any length, and a copy is trained for each group."""
    import pyarrow as pa

    rng = random.Random(12)
    ids = [np.array([rng.randrange(1, 1024) for _ in range(n)], "<u2") for n in [*range(40), 500, 5000]]
    groups = [0] * 30 + [2] * (len(ids) - 30)
    batch = pa.RecordBatch.from_arrays([pa.array(groups), pa.array([i.tobytes() for i in ids], pa.binary())], ["group", "ids"])
    seen = Counter()
    for turn in range(lm_score.ROUNDS):
        for r in lm_score._trainer(1024, _Sent(lm_score.initial()), turn)(iter([batch])):
            seen.update(dict(zip(r["group"].to_pylist(), r["seen"].to_pylist(), strict=True)))
    assert seen == {0: sum(range(30)), 2: sum(range(30, 40)) + 5500}


def test_lm_network():
    """The log-probabilities against a softmax written out, and the gradient against differences."""
    rng = np.random.default_rng(1)
    p = [x.astype(np.float64) + rng.standard_normal(x.shape) * 0.1 for x in lm_score._unpack(lm_score.initial(), 1024)]
    context, target = rng.integers(0, 1024, (50, 4)), rng.integers(0, 1024, 50)

    def naive(c, t):
        h = np.tanh(p[1] + sum(p[0][k][c[k]] for k in range(4)))
        soft = lambda x: x - np.log(np.exp(x).sum())
        inner = p[5].shape[1]
        return soft(h @ p[2] + p[3])[t // inner] + soft(h @ p[4][t // inner] + p[5][t // inner])[t % inner]

    loss = lambda: -lm_score.log_probs(p, context, target).sum()
    assert lm_score.log_probs(p, context, target) == pytest.approx([naive(c, t) for c, t in zip(context, target, strict=True)])
    rows, of_rows, others = lm_score._gradient(p, context, target)
    wide = np.zeros((4 * 1024, lm_score.WIDTH))
    wide[rows] = of_rows
    for w, g in zip(p, [wide.reshape(p[0].shape), *others], strict=True):
        for at in np.argsort(-np.abs(g).ravel())[[0, 3, 9]]:
            w, old = w.reshape(-1), w.reshape(-1)[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            assert g.reshape(-1)[at] == pytest.approx((up - loss()) / 2e-5, rel=1e-4, abs=1e-7)
            w[at] = old


def test_lm_reads_each_word_of_a_run_once(monkeypatch):
    """A rare word is looked up once for a run of texts, not at each place; texts of any blanks, and longer than a run, are read as word by word."""
    import pyarrow as pa

    known, rare = [b"the", b"of"], [b"seldom"]
    words = lm_score._Vocabulary(known, rare, np.array([3]))
    buckets = np.log(np.arange(1.0, lm_score.RARE + 2))
    texts = ["the odd Odd\x0b\todd " * 500, None, "", " \n ", "  The of\r\nof seldom", "\u00c9t\u00e9\u00a0x \u00e9", "odd the", " seldom " * 40 + "odd\x1cone two"] * 3
    bucket, asked = lm_score._bucket, Counter()
    monkeypatch.setattr(lm_score, "_bucket", lambda w: asked.update([w]) or bucket(w))
    batch = pa.RecordBatch.from_arrays([pa.array([b"%d" % i for i in range(len(texts))]), pa.array(texts)], ["key", "text"])
    for piece in (1 << 20, 64):
        monkeypatch.setattr(lm_score, "_PIECE", piece, raising=False)
        asked.clear()
        rows = [r for b in lm_score._encoder(_Sent((words, buckets)))(iter([batch])) for r in b.to_pylist()]
        assert piece == 64 or set(asked.values()) == {1}
        for i, (text, row) in enumerate(zip(texts, rows, strict=True)):
            own = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
            ids = [lm_score.RARE + 1 + known.index(w) if w in known else bucket(w) for w in own]
            tail = Counter()
            for t in row["tail"]:
                tail[t["word"]] += t["n"]
            assert row["key"] == b"%d" % i and np.frombuffer(row["ids"], "<u2").tolist() == ids
            assert tail == Counter(w for w in own if w not in known + rare)
            assert row["known"] == pytest.approx(sum(math.log(3) * (w in rare) - (buckets[bucket(w)] if w not in known else 0) for w in own))
        counts = Counter()
        for b in lm_score._count_words(iter([batch.select([1])])):
            counts.update(dict(zip(b[0].to_pylist(), b[1].to_pylist(), strict=True)))
        assert counts == Counter(w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()))


def test_lm_gradient_of_many_equal_words():
    """Gradients of words found hundreds of times are the sums over their places, and logits of any size are safe."""
    rng = np.random.default_rng(2)
    p = [x.astype(np.float64) + rng.standard_normal(x.shape) * 0.1 for x in lm_score._unpack(lm_score.initial(), 1024)]
    context, target = rng.integers(0, 1024, (3000, 4)), rng.integers(0, 1024, 3000)
    context[:, 1], context[:700, 0], context[:65, 2] = 5, 9, 77
    places = [slice(a, a + 5) for a in range(0, 3000, 5)]

    def dense(*parts):
        wide, others = np.zeros((4 * 1024, lm_score.WIDTH)), 0
        for part in parts:
            rows, of_rows, g = lm_score._gradient(p, context[part], target[part])
            assert len(set(rows.tolist())) == len(rows)
            wide[rows] += of_rows
            others = others + np.concatenate([x.ravel() for x in g])
        return wide, others

    for got, want in zip(dense(slice(None)), dense(*places), strict=True):
        assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
    big = [x.astype(np.float32) for x in p]
    big[3][::2] += 300
    big[5][:, 1::2] -= 400
    assert np.isfinite(lm_score.log_probs(big, context, target)).all() and all(np.isfinite(x).all() for x in lm_score._gradient(big, context, target)[2])


def test_lm_is_the_same_for_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "GROUP", 1500)
    rng = random.Random(14)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(120)] + ["said many times"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    models = [lm_score.train(x) for x in (df.repartition(1), df.repartition(7, "text"))]
    assert np.array_equal(models[0].weights, models[1].weights)
    got = [{r.doc_id: r.log_prob for r in lm_score.score(df, m).collect()} for m in models]
    assert got[0] == pytest.approx(got[1], rel=1e-6)


def test_lm_word_counts(spark, monkeypatch):
    """A rare word counts by its own share of its bucket, whether its count is broadcast or joined; the network grows with the corpus."""
    import zlib

    common = [f"c{i}" for i in range(1200)]
    odd = [f"r{i}" for i in range(4000)]
    by_bucket = {}
    for w in odd:
        by_bucket.setdefault(zlib.crc32(w.encode()) % lm_score.RARE, []).append(w)
    often, seldom, once = by_bucket[7][:3]
    lines = [" ".join(common)] * 40 + [f"{often} " * 24 + f"{seldom} " * 3 + once] + [" ".join(odd[:3000])]
    learn = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    asked = [*(f"c1 {w} c2" for w in (often, seldom, once, next(w for w in by_bucket[7] if w not in odd[:3000]))), f"c1 {seldom} c2", None]
    ask = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").repartition(2)
    in_all = Counter(" ".join(lines).split())
    for head in (1000, 60_000):
        monkeypatch.setattr(lm_score, "HEAD", head)
        got = {r.doc_id: r.log_prob for r in lm_score.score(ask, lm_score.train(learn)).collect()}
        for i, w in ((0, often), (1, seldom)):
            assert abs(got[i] - got[2] - math.log(in_all[w] / in_all[once])) < 1e-4
        assert abs(got[2] - got[3] - math.log(in_all[once])) < 1e-4 and got[1] == got[4] and got[5] == 0
    assert [lm_score.VOCAB << lm_score._doublings(n) for n in (0, 4_000_000, 20_000_000, 100_000_000)] == [1024, 1024, 2048, 4096]
    assert len(lm_score.initial(4096)) > 3.5 * len(lm_score.initial())
    p = lm_score._unpack(lm_score.initial(4096), 4096)
    one = np.zeros((4096, 4), np.int64)
    assert abs(np.exp(lm_score.log_probs(p, one, np.arange(4096))).sum() - 1) < 1e-3


def test_digests_follow_the_contract(spark):
    from millrace.llm import queries

    r = next(r for r in queries.op7_chat_format(spark, "/root/testdata/sf0.001").collect() if r.conv_id == -7)
    text = "</s>[INST] ok [/INST]"
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (r.loss_chars, r.loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
