"""Placeholders against a quadratic walk, and texts restored."""

import random
import re

from pyspark.sql import functions as F

from millrace.operators import spans

KIND = "i long, text string, values array<struct<value:string,type:string>>"


def walk(text, values):
    found = [(i, i + len(v), v, k) for v, k in values if v for i in range(len(text) - len(v) + 1) if text[i : i + len(v)] == v]
    chosen = []
    for s in sorted(found, key=lambda c: (c[0] - c[1], c[0])):
        if all(s[1] <= c[0] or c[1] <= s[0] for c in chosen):
            chosen.append(s)
    return sorted(chosen)


def test_spans_as_by_a_walk(spark):
    rng = random.Random(2)
    rows = [(0, None, [("a", "A")]), (1, "", [("a", "A")]), (2, "plain", None), (3, "plain", []), (4, "aaaa", [("aa", "A"), ("aa", "B"), (None, "C"), ("", "C"), ("a", None)]), (5, "12点2人", [("2", "PEOPLE"), ("12点", "TIME")]), (6, "see <A_1> and <A_3> b", [("b", "A"), ("see", "A"), ("and", "A")]), (7, "é😀é", [("😀", "E"), ("é", "F")])]
    for i in range(8, 300):
        values = [("".join(rng.choice("ab<1>A_") for _ in range(rng.randint(1, 5))), rng.choice(("A", "BC"))) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(rng.choice("ab<1>A_ ") for _ in range(rng.randint(0, 60))), values))
    df = spark.createDataFrame(rows, KIND).withColumn("h", spans.hide(F.col("text"), F.col("values")))
    got = {r.i: r for r in df.withColumn("back", spans.restore(F.col("h.hidden"), F.col("h.spans"))).collect()}
    for i, text, values in rows:
        r = got[i]
        known = [(v, k) for v, k in values or () if v and k]
        assert r.back == text, (text, values, r)
        assert [(s.start, s.end, s.value, s.type) for s in r.h.spans] == (walk(text, known) if text else [])
        assert len({s.token for s in r.h.spans}) == len(r.h.spans) and not any(s.token in (text or "") for s in r.h.spans)
    assert got[5].h.hidden == "<TIME_1><PEOPLE_1>人" and got[6].h.hidden == "<A_2> <A_1> <A_4> <A_3> <A_5>" and got[4].h.hidden == "<A_1><A_2>"


def test_long_texts_with_many_values():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    text = " ".join(rng.choice(words) for _ in range(60_000))
    found = spans.find_spans(text, [(w, "W") for w in words])
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False)) and all(text[s:e] == v for s, e, v, _ in found)
    assert set("".join(re.sub(r"\S", "x", text[a[1] : b[0]]) for a, b in zip(found, found[1:], strict=False))) <= {" ", "x"}


def test_sets_of_tokens(spark):
    rows = [("<A_1> <B_2> <B_2>", "<B_2> <A_1>"), ("<A_1>", "<A_1> <A_2>"), ("<A_1>", "none"), (None, "<A_1>"), ("a_1 <a_1> <A_>", None)]
    df = spark.createDataFrame(rows, "x string, y string")
    x, y = F.col("x"), F.col("y")
    got = [tuple(r) for r in df.select(spans.lost_tokens(x, y), spans.new_tokens(x, y), spans.token_counts(x), spans.marked(x)).collect()]
    assert got == [([], [], {"A": 1, "B": 2}, "某 某 某"), ([], ["<A_2>"], {"A": 1}, "某"), (["<A_1>"], [], {"A": 1}, "某"), ([], ["<A_1>"], {}, None), ([], [], {}, "a_1 <a_1> <A_>")]
