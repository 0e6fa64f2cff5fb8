"""The text in nested JSON."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import stripped


def _texts(value: object) -> list[str]:
    """Texts at any depth in the order of the document, without recursion, so that depth isn't bounded by Python's stack. Objects come as lists of pairs."""
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, _Pairs):
            stack.extend(x for _, x in reversed(v))
        elif isinstance(v, list):
            stack.extend(reversed(v))
    return out


class _Pairs(list):
    """An object with its keys in order, repeated ones included."""


def _parse(text: str | None) -> object:
    try:
        return json.loads(text or "", object_pairs_hook=_Pairs)
    except (ValueError, RecursionError):
        return _Pairs()


def string_leaves(text: Column) -> Column:
    """All texts in a JSON value, keys apart, in the order of the document; none for null and for what isn't JSON or is nested deeper than Python's parser goes (it is taken for an empty object)."""

    @F.arrow_udf("array<string>")
    def each(texts: pa.Array) -> pa.Array:
        return pa.array([_texts(_parse(t)) for t in texts.to_pylist()], pa.list_(pa.string()))

    return each(text)


def calibration_line(text: Column) -> Column:
    """The texts of a row, stripped, a line each, blank ones left out."""
    return F.array_join(F.filter(F.transform(string_leaves(text), stripped), lambda x: x != ""), "\n")
