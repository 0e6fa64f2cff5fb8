"""Structure of JSON values, described once and checked as one column over VARIANT.

A shape says which type a value has, which keys an object must and may have, how many items a list holds, and which variant of a union a tag picks. ``problems`` compiles it to a
column: an array of (path, issue) for one value. A typed ``from_json`` can't do this: it makes one of a key that is absent, one that is null and one of the wrong type.

Issues: ``json`` (a text that isn't JSON), ``type``, ``null``, ``missing``, ``extra``, ``value`` (a constant, pattern or date that doesn't hold), ``few``, ``many``, ``tag`` (a union has no
such variant). A value of the wrong type is not looked into. An object with one key twice isn't JSON here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBLEMS = "array<struct<path:string,issue:string>>"


@dataclass(frozen=True)
class Leaf:
    """A scalar: its JSON type (text, whole, number, flag, null), the values it may have, a pattern, or whether it must be a calendar day."""

    kind: str
    values: tuple[str, ...] = ()
    pattern: str = ""
    day: bool = False


@dataclass(frozen=True)
class Nullable:
    of: Shape


@dataclass(frozen=True)
class Items:
    """A list of one shape, with the least and the greatest number of items."""

    of: Shape
    least: int = 0
    most: int | None = None


@dataclass(frozen=True)
class Record:
    """An object of known keys; ``optional`` ones may be absent. Unknown keys are extra unless it is open."""

    fields: dict[str, Shape] = field(hash=False)
    optional: frozenset[str] = frozenset()
    open: bool = False


@dataclass(frozen=True)
class Union:
    """An object whose tags (values of top-level texts) pick one of the variants."""

    tags: tuple[str, ...]
    variants: dict[tuple[str, ...], Shape] = field(hash=False)


@dataclass(frozen=True)
class Having:
    """An object that has one shape if a key holds a list with items (or any other value that isn't empty), else another."""

    key: str
    then: Shape
    otherwise: Shape


@dataclass(frozen=True)
class Inside:
    """A text that is JSON itself."""

    of: Shape


Shape = Leaf | Nullable | Items | Record | Union | Having | Inside

TEXT, WHOLE, NUMBER, FLAG, NULL = (Leaf(k) for k in ("text", "whole", "number", "flag", "null"))
DAY = Leaf("text", day=True)
ANY_OBJECT = Record({}, open=True)


def one_of(*values: str) -> Leaf:
    return Leaf("text", values)


def optional(fields: dict[str, Shape], **required: Shape) -> Record:
    """A record whose ``fields`` may be absent."""
    return Record({**required, **fields}, frozenset(fields))


#: Types of schema_of_variant. An integer that a long can't hold is a decimal without places of 19 digits or more; 3.0 is a decimal too, but a short one.
_WHOLE, _NUMBER = r"^DECIMAL\((19|[23]\d),0\)$", "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"
_KINDS: dict[str, Callable[[Column], Column]] = {
    "text": lambda s: s == "STRING", "whole": lambda s: (s == "BIGINT") | s.rlike(_WHOLE), "number": lambda s: s.rlike(_NUMBER), "flag": lambda s: s == "BOOLEAN", "null": lambda s: s == "VOID",
}


def _none() -> Column:
    return F.array().cast(PROBLEMS)


def _problem(path: Column, issue: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(issue).alias("issue")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    # element_at keeps its type; an index would ask for the type of the whole body, bodies within it and all, for every row
    return F.element_at(F.transform(F.array(value), body), 1)


def _of_null(path: Column, nullable: bool) -> Column:
    return _none() if nullable else _problem(path, "null")


def _scalar(value: Column, kind: str, path: Column, nullable: bool, inside: Column) -> Column:
    # the type of a scalar is short; that of an object is its whole schema, so objects and lists are never asked for theirs
    return let(F.schema_of_variant(value), lambda s: F.when(_KINDS[kind](s), inside).when(s == "VOID", _of_null(path, nullable)).otherwise(_problem(path, "type")))


def _nested(value: Column, type_: str, path: Column, nullable: bool, body: Callable[[Column], Column]) -> Column:
    """``body`` of an object's entries or a list's items, taken apart once."""
    other = F.when(F.is_variant_null(value), _of_null(path, nullable)).otherwise(_problem(path, "type"))
    return let(F.try_variant_get(value, "$", type_), lambda parts: F.when(parts.isNotNull(), body(parts)).otherwise(other))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _leaf(shape: Leaf, value: Column, path: Column, nullable: bool) -> Column:
    if shape.kind == "null":
        return F.when(F.is_variant_null(value), _none()).otherwise(_problem(path, "type"))
    text, odd = _text(value), []
    if shape.values:
        odd.append(~text.isin(*shape.values))
    if shape.pattern:
        odd.append(~text.rlike(shape.pattern))
    if shape.day:
        odd.append(~text.rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date(text, "yyyy-MM-dd").isNull())
    fits = _none()
    for o in odd:
        fits = F.when(o, _problem(path, "value")).otherwise(fits)
    return _scalar(value, shape.kind, path, nullable, fits)


def _record(shape: Record, entries: Column, path: Column) -> Column:
    found = []
    for name, kind in shape.fields.items():
        at = F.concat(path, F.lit(f".{name}"))
        absent = _none() if name in shape.optional else _problem(at, "missing")
        # a JSON null is a value here; a key that is absent gives none
        found.append(let(F.try_element_at(entries, F.lit(name)), _present(kind, at, absent)))
    if not shape.open:
        unknown = F.filter(F.map_keys(entries), lambda k: ~k.isin(*shape.fields)) if shape.fields else F.map_keys(entries)
        extra = lambda keys: F.transform(F.array_sort(keys), lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("extra").alias("issue")))
        found.append(let(unknown, lambda keys: F.when(F.size(keys) == 0, _none()).otherwise(extra(keys))))
    return F.concat(*found) if found else _none()


def _present(shape: Shape, path: Column, absent: Column) -> Callable[[Column], Column]:
    return lambda v: F.when(v.isNull(), absent).otherwise(_check(shape, v, path))


def _union(shape: Union, entries: Column, path: Column) -> Column:
    def pick(said: list[Column]) -> Column:
        if len(said) < len(shape.tags):
            return let(_text(F.try_element_at(entries, F.lit(shape.tags[len(said)]))), lambda t: pick([*said, t]))
        out = F.when(F.lit(False), _none())
        for tags, variant in shape.variants.items():
            fits = F.lit(True)
            for tag, t in zip(tags, said, strict=True):
                fits = fits & t.eqNullSafe(tag)
            out = out.when(fits, _of_object(variant, entries, path))
        return out.otherwise(_problem(path, "tag"))

    return pick([])


def _having(shape: Having, entries: Column, path: Column) -> Column:
    empty = F.to_json(F.try_element_at(entries, F.lit(shape.key))).isin("null", "[]", "{}", '""', "0", "false")
    return F.when(F.coalesce(~empty, F.lit(False)), _of_object(shape.then, entries, path)).otherwise(_of_object(shape.otherwise, entries, path))


def _of_object(shape: Record | Union | Having, entries: Column, path: Column) -> Column:
    return {Record: _record, Union: _union, Having: _having}[type(shape)](shape, entries, path)


def _items(shape: Items, items: Column, path: Column) -> Column:
    each = F.flatten(F.transform(items, lambda v, i: _check(shape.of, v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
    few = F.when(F.size(items) < shape.least, _problem(path, "few")).otherwise(_none())
    many = F.when(F.size(items) > shape.most, _problem(path, "many")).otherwise(_none()) if shape.most is not None else _none()
    return F.concat(few, many, each)


def _inside(shape: Inside, value: Column, path: Column, nullable: bool) -> Column:
    parsed = F.try_parse_json(_text(value))
    return _scalar(value, "text", path, nullable, let(parsed, lambda v: F.when(v.isNull(), _problem(path, "json")).otherwise(_check(shape.of, v, path))))


def _check(shape: Shape, value: Column, path: Column, nullable: bool = False) -> Column:
    if isinstance(shape, Nullable):
        return _check(shape.of, value, path, True)
    if isinstance(shape, Items):
        return _nested(value, "array<variant>", path, nullable, lambda items: _items(shape, items, path))
    if isinstance(shape, (Record, Union, Having)):
        return _nested(value, "map<string,variant>", path, nullable, lambda entries: _of_object(shape, entries, path))
    return (_inside if isinstance(shape, Inside) else _leaf)(shape, value, path, nullable)


def problems(shape: Shape, value: Column) -> Column:
    """What is wrong with a VARIANT, as an array of (path, issue) in the order of the shape; empty if nothing is. A null VARIANT is no JSON."""
    return F.when(value.isNull(), _problem(F.lit("$"), "json")).otherwise(let(value, lambda v: _check(shape, v, F.lit("$"))))


def problems_of_text(shape: Shape, text: Column) -> Column:
    """The same of a JSON text."""
    return let(F.try_parse_json(text), lambda v: problems(shape, v))
