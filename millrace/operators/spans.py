"""Values of a text hidden behind numbered placeholders, and put back.

Each row brings its own values, so nothing is broadcast or shuffled. All occurrences of all values are found, overlapping ones too; longer ones win, of equal length the
earlier, of one place the value listed first. Each hidden span gets a token of its own (``<TYPE_1>``, ``<TYPE_2>``, ... in the order of the text), never one that the text has already.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"<[A-Z]+_\d+>"
#: What stands for a token where only the shape of a text counts.
MARK = "某"
HIDDEN = "struct<hidden:string,spans:array<struct<start:long,end:long,value:string,type:string,token:string>>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("type", pa.string()), ("token", pa.string())])
_HIDDEN = pa.struct([("hidden", pa.string()), ("spans", pa.list_(_SPAN))])


def find_spans(text: str, values: list[tuple[str, str]]) -> list[tuple[int, int, str, str]]:
    """Spans (start, end, value, type) that don't overlap, in the order of the text. Chosen starts are kept sorted, so a span is held against its two neighbours only."""
    found = []
    for value, kind in dict.fromkeys(values):
        at = text.find(value) if value else -1
        while at >= 0:
            found.append((at, at + len(value), value, kind))
            at = text.find(value, at + 1)
    found.sort(key=lambda c: (c[0] - c[1], c[0]))
    starts: list[int] = []
    chosen: dict[int, tuple[int, int, str, str]] = {}
    for span in found:
        i = bisect_right(starts, span[0])
        if (i and chosen[starts[i - 1]][1] > span[0]) or (i < len(starts) and starts[i] < span[1]):
            continue
        insort(starts, span[0])
        chosen[span[0]] = span
    return [chosen[s] for s in starts]


def _hide_one(text: str, values: list[tuple[str, str]]) -> dict:
    taken, numbers, out, spans, at = set(re.findall(TOKEN, text)), {}, [], [], 0
    for start, end, value, kind in find_spans(text, values):
        n = numbers.get(kind, 0) + 1
        while f"<{kind}_{n}>" in taken:
            n += 1
        numbers[kind], token = n, f"<{kind}_{n}>"
        out += [text[at:start], token]
        spans.append({"start": start, "end": end, "value": value, "type": kind, "token": token})
        at = end
    return {"hidden": "".join([*out, text[at:]]), "spans": spans}


def hide(text: Column, values: Column) -> Column:
    """A struct of the text with its values hidden and the spans (start and end in code points from 0, value, type, token).

    ``values`` is an array of (value, type); types are of capital letters. Null and empty values are left out, null values hide nothing; a null text stays null, without spans."""

    @F.arrow_udf(HIDDEN)
    def each(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), lists.to_pylist(), strict=True)
        known = lambda vs: [(v["value"], v["type"]) for v in vs or () if v and v["value"] and v["type"]]
        return pa.array([{"hidden": None, "spans": []} if t is None else _hide_one(t, known(vs)) for t, vs in rows], _HIDDEN)

    pair = "array<struct<value:string,type:string>>"
    return each(text, values.cast(pair))


def restore(hidden: Column, spans: Column) -> Column:
    """The text with each token of ``spans`` (value, token) put back, in one pass: what a value holds is never replaced again. Tokens that no span has stay."""

    @F.arrow_udf("string")
    def each(texts: pa.Array, lists: pa.Array) -> pa.Array:
        def back(text: str | None, of: list | None) -> str | None:
            known = {s["token"]: s["value"] for s in of or ()}
            return None if text is None else re.sub(TOKEN, lambda m: known.get(m[0], m[0]), text)

        return pa.array([back(t, of) for t, of in zip(texts.to_pylist(), lists.to_pylist(), strict=True)], pa.string())

    return each(hidden, spans)


def tokens(text: Column) -> Column:
    """The distinct tokens of a text, sorted; none for null."""
    return F.array_sort(F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))))


def lost_tokens(before: Column, after: Column) -> Column:
    return F.array_except(tokens(before), tokens(after))


def new_tokens(before: Column, after: Column) -> Column:
    """Empty where the tokens of ``after`` are a subset."""
    return F.array_except(tokens(after), tokens(before))


def token_counts(text: Column) -> Column:
    """A map from type to number of its tokens in a text, each occurrence counted."""
    kinds = F.coalesce(F.regexp_extract_all(text, F.lit(r"<([A-Z]+)_\d+>"), F.lit(1)), F.array().cast("array<string>"))
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)).cast("long"))))


def marked(text: Column) -> Column:
    """Each token as one mark."""
    return F.regexp_replace(text, TOKEN, MARK)
