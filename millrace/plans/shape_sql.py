"""DuckDB SQL that finds the problems of a JSON value by a shape, with DuckDB's own JSON functions."""

from __future__ import annotations

from itertools import count

from millrace.operators.shapes import Having, Inside, Items, Leaf, Nullable, Record, Shape, Union

_KINDS = {"text": "'VARCHAR'", "whole": "'BIGINT', 'UBIGINT', 'HUGEINT'", "number": "'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE'", "flag": "'BOOLEAN'", "null": "'NULL'", "object": "'OBJECT'", "list": "'ARRAY'"}
_NONE = "CAST([] AS STRUCT(path VARCHAR, issue VARCHAR)[])"


def _problem(path: str, issue: str) -> str:
    return f"[{{'path': {path}, 'issue': '{issue}'}}]"


def _guarded(kind: str, j: str, path: str, inside: str) -> str:
    return f"CASE WHEN json_type({j}) = 'NULL' THEN {_problem(path, 'null')} WHEN json_type({j}) NOT IN ({_KINDS[kind]}) THEN {_problem(path, 'type')} ELSE {inside} END"


def problems_sql(shape: Shape, j: str, path: str = "'$'", _names: count | None = None) -> str:
    """A SQL expression for the list of problems of the JSON expression ``j``."""
    names = _names or count()

    def of(s: Shape, value: str, at: str) -> str:
        """``value`` bound once, as the variable of a lambda."""
        n = f"j{next(names)}"
        return f"list_transform([{value}], lambda {n}: {problems_sql(s, n, at, names)})[1]"

    text = f"({j} ->> '$')"
    if isinstance(shape, Leaf):
        if shape.kind == "null":
            return f"CASE WHEN json_type({j}) = 'NULL' THEN {_NONE} ELSE {_problem(path, 'type')} END"
        odd = []
        if shape.values:
            odd.append(f"{text} NOT IN ({', '.join(repr(v) for v in shape.values)})")
        if shape.pattern:
            odd.append(f"NOT regexp_matches({text}, '{shape.pattern}')")
        if shape.day:
            odd.append(f"NOT regexp_matches({text}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') OR TRY_CAST({text} AS DATE) IS NULL")
        return _guarded(shape.kind, j, path, f"CASE WHEN {' OR '.join(odd)} THEN {_problem(path, 'value')} ELSE {_NONE} END" if odd else _NONE)
    if isinstance(shape, Nullable):
        return f"CASE WHEN json_type({j}) = 'NULL' THEN {_NONE} ELSE {problems_sql(shape.of, j, path, names)} END"
    if isinstance(shape, Record):
        found = [_NONE]
        for name, kind in shape.fields.items():
            at = f"{path} || '.{name}'"
            found.append(f"CASE WHEN list_contains(json_keys({j}), '{name}') THEN {of(kind, f"{j} -> '$.{name}'", at)} ELSE {_NONE if name in shape.optional else _problem(at, 'missing')} END")
        if not shape.open:
            known, k = ", ".join(f"'{n}'" for n in shape.fields), f"k{next(names)}"
            found.append(f"list_transform(list_filter(json_keys({j}), lambda {k}: {k} NOT IN ({known})), lambda {k}: {{'path': {path} || '.' || {k}, 'issue': 'extra'}})")
        out = found[0]
        for f in found[1:]:
            out = f"list_concat({out}, {f})"
        return _guarded("object", j, path, out)
    if isinstance(shape, Items):
        v, i, size = f"v{next(names)}", f"i{next(names)}", f"json_array_length({j})"
        each = f"coalesce(flatten(list_transform(CAST({j} AS JSON[]), lambda {v}, {i}: {problems_sql(shape.of, f"coalesce({v}, CAST('null' AS JSON))", f"{path} || '[' || ({i} - 1) || ']'", names)})), {_NONE})"
        few = f"CASE WHEN {size} < {shape.least} THEN {_problem(path, 'few')} ELSE {_NONE} END"
        many = f"CASE WHEN {size} > {shape.most} THEN {_problem(path, 'many')} ELSE {_NONE} END" if shape.most is not None else _NONE
        return _guarded("list", j, path, f"list_concat(list_concat({few}, {many}), {each})")
    if isinstance(shape, Union):
        when = " ".join(f"WHEN {' AND '.join(f"coalesce({j} ->> '$.{k}' = '{t}', false)" for k, t in zip(shape.tags, tags, strict=True))} THEN {problems_sql(s, j, path, names)}" for tags, s in shape.variants.items())
        return _guarded("object", j, path, f"CASE {when} ELSE {_problem(path, 'tag')} END")
    if isinstance(shape, Having):
        full = f"coalesce(CAST({j} -> '$.{shape.key}' AS VARCHAR) NOT IN ('null', '[]', '{{}}', '\"\"', '0', 'false'), false)"
        return _guarded("object", j, path, f"CASE WHEN {full} THEN {problems_sql(shape.then, j, path, names)} ELSE {problems_sql(shape.otherwise, j, path, names)} END")
    assert isinstance(shape, Inside)
    return _guarded("text", j, path, f"CASE WHEN json_valid({text}) THEN {of(shape.of, f"CAST({text} AS JSON)", path)} ELSE {_problem(path, 'json')} END")


def problems_of_text_sql(shape: Shape, text: str) -> str:
    return f"CASE WHEN coalesce(json_valid({text}), false) THEN list_transform([CAST({text} AS JSON)], lambda j: {problems_sql(shape, 'j')})[1] ELSE {_problem("'$'", 'json')} END"
