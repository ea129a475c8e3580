"""Walking nested values by schema.

The schema is walked once on the driver and yields one expression; rows are never
walked in Python.  Strings are rewritten by a leaf function, in arrays, structs
and map values at any depth.  Map keys, field names and every other type stay as
they are.

A leaf maps ``(text, place)`` to ``struct<value, n, types, entity_types>``; the two
kind lists stay apart until the whole record is merged, because all kinds of the
pattern stage come before those of the entity stage.  The place is either a path
(``PATHS``) or the text's counterpart in a value of the same shape (``MIRRORS``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import types as T

from hushframe.functions.jsontext import redact_json_text
from hushframe.functions.masks import NO_TYPES, redact
from hushframe.functions.sqltext import (
    Sql,
    aggregate,
    empty,
    let,
    lit,
    struct,
    transform,
    transform_indexed,
    when,
)

Leaf = Callable[[Sql, Sql], Sql]

# Characters that separate the parts of a path; in a name a backslash goes before them.
_SPECIAL = ("\\", ".", "[", "]")


def escaped(name: str) -> str:
    """A column or field name as part of a path."""
    for c in _SPECIAL:
        name = name.replace(c, "\\" + c)
    return name


def _escaped(key: Sql) -> Sql:
    for c in _SPECIAL:
        key = f"replace({key}, {lit(c)}, {lit(chr(92) + c)})"
    return key


class PATHS:
    """Places as text: ``column.field[2][key]``, names and keys escaped."""

    @staticmethod
    def field(place: Sql, name: str) -> Sql:
        return f"concat({place}, {lit('.' + escaped(name))})"

    @staticmethod
    def item(place: Sql, index: Sql) -> Sql:
        return f"concat({place}, '[', cast({index} AS string), ']')"

    @staticmethod
    def entry(place: Sql, key: Sql, index: Sql) -> Sql:
        return f"concat({place}, {lit('[')}, {_escaped(f'cast({key} AS string)')}, ']')"


class MIRRORS:
    """Places as counterparts in a value of the shape ``mirror`` makes."""

    @staticmethod
    def field(place: Sql, name: str) -> Sql:
        return field(place, name)

    @staticmethod
    def item(place: Sql, index: Sql) -> Sql:
        return f"get({place}, {index})"

    @staticmethod
    def entry(place: Sql, key: Sql, index: Sql) -> Sql:
        return f"get({place}, {index})"


def pattern_leaf(text: Sql, path: Sql) -> Sql:
    """Pattern stage only."""
    return let(
        redact(text),
        lambda r: struct(
            value=f"{r}.value", n=f"{r}.n", types=f"{r}.types", entity_types=NO_TYPES
        ),
    )


def variant_leaf(kept: Callable[[Sql], Sql]) -> Callable[[Sql], Sql]:
    """Leaf for a VARIANT: ``kept`` redacts its JSON text, values only."""

    def leaf(value: Sql) -> Sql:
        # The text is bound: it would be written again for each test and copy of it.
        return let(
            let(f"to_json({value})", kept),
            lambda r: struct(
                value=when((f"{r}.n > 0", f"parse_json({r}.value)"), other=value),
                n=f"{r}.n",
                types=f"{r}.types",
                entity_types=f"{r}.entity_types",
            ),
        )

    return leaf


# A leaf with this attribute can also read VARIANT.
pattern_leaf.variant = variant_leaf(lambda text: redact_json_text(text, valid=True))


def holds_text(kind: T.DataType) -> bool:
    """Whether a value of this type can contain a string value."""
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType, T.VariantType)):
        return True
    if isinstance(kind, T.ArrayType):
        return holds_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return holds_text(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(holds_text(f.dataType) for f in kind.fields)
    return False


def field(value: Sql, name: str) -> Sql:
    return f"{value}.`{name.replace('`', '``')}`"


def _merged(value: Sql, parts: Sql) -> Sql:
    """Merge child results: counts add up, kinds follow each other, one per redaction."""
    return struct(
        value=value,
        n=aggregate(parts, "0", lambda n, x: f"{n} + {x}.n"),
        types=f"flatten({parts}.types)",
        entity_types=f"flatten({parts}.entity_types)",
    )


def _stats(result: Sql) -> Sql:
    return struct(
        n=f"{result}.n",
        types=f"{result}.types",
        entity_types=f"{result}.entity_types",
    )


def _nothing(value: Sql) -> Sql:
    return struct(value=value, n="0", types=NO_TYPES, entity_types=NO_TYPES)


def rewrite(value: Sql, kind: T.DataType, place: Sql, leaf: Leaf, nav: type = PATHS) -> Sql:
    """Result of the walk over one value: struct<value, n, types, entity_types>."""
    if not holds_text(kind):
        return _nothing(value)

    if isinstance(kind, T.VariantType):
        of_variant = getattr(leaf, "variant", None)
        if of_variant is None:
            raise ValueError("this stage cannot read VARIANT; name other columns")
        hit = of_variant(value)
    elif isinstance(kind, T.ArrayType):
        items = transform_indexed(
            value,
            lambda x, i: rewrite(x, kind.elementType, nav.item(place, i), leaf, nav),
        )
        hit = let(items, lambda rs: _merged(f"{rs}.value", rs))
    elif isinstance(kind, T.MapType):
        items = transform_indexed(
            f"map_entries({value})",
            lambda e, i: rewrite(
                f"{e}.value", kind.valueType, nav.entry(place, f"{e}.key", i), leaf, nav
            ),
        )
        hit = let(
            items,
            lambda rs: _merged(f"map_from_arrays(map_keys({value}), {rs}.value)", rs),
        )
    elif isinstance(kind, T.StructType):
        texts = [f for f in kind.fields if holds_text(f.dataType)]
        items = ", ".join(
            rewrite(
                field(value, f.name), f.dataType, nav.field(place, f.name), leaf, nav
            )
            + f" AS f{i}"
            for i, f in enumerate(texts)
        )

        def join_struct(rs: Sql) -> Sql:
            place = {f.name: i for i, f in enumerate(texts)}
            fields = [
                f"{rs}.f{place[f.name]}.value"
                if f.name in place
                else field(value, f.name)
                for f in kind.fields
            ]
            named = ", ".join(
                f"{x} AS `{f.name.replace('`', '``')}`"
                for x, f in zip(fields, kind.fields)
            )
            parts = ", ".join(_stats(f"{rs}.f{i}") for i in range(len(texts)))
            return _merged(f"struct({named})", f"array({parts})")

        hit = let(f"struct({items})", join_struct)
    else:
        return leaf(value, place)

    return when((f"{value} IS NOT NULL", hit), other=_nothing(value))


def text_leaves(value: Sql, kind: T.DataType, path: Sql) -> Sql:
    """All string values in traversal order: array<struct<path, text>>."""
    none = empty("struct<path:string,text:string>")
    if not holds_text(kind) or isinstance(kind, T.VariantType):
        return none
    if isinstance(kind, T.ArrayType):
        inner = transform_indexed(
            value, lambda x, i: text_leaves(x, kind.elementType, PATHS.item(path, i))
        )
        inner = f"flatten({inner})"
    elif isinstance(kind, T.MapType):
        inner = transform(
            f"map_entries({value})",
            lambda e: text_leaves(
                f"{e}.value", kind.valueType, PATHS.entry(path, f"{e}.key", "")
            ),
        )
        inner = f"flatten({inner})"
    elif isinstance(kind, T.StructType):
        parts = ", ".join(
            text_leaves(field(value, f.name), f.dataType, PATHS.field(path, f.name))
            for f in kind.fields
            if holds_text(f.dataType)
        )
        inner = f"concat({parts})"
    else:
        inner = f"array({struct(path=path, text=value)})"
    return when((f"{value} IS NOT NULL", inner), other=none)


def mirror(value: Sql, kind: T.DataType, text: Callable[[Sql], Sql]) -> Sql:
    """``text`` of the texts of a value, in its own shape: arrays, maps as arrays of their
    values, structs of the fields that hold text."""
    if isinstance(kind, T.ArrayType):
        return transform(value, lambda x: mirror(x, kind.elementType, text))
    if isinstance(kind, T.MapType):
        return transform(f"map_values({value})", lambda x: mirror(x, kind.valueType, text))
    if isinstance(kind, T.StructType):
        parts = ", ".join(
            f"{mirror(field(value, f.name), f.dataType, text)} AS `{f.name.replace('`', '``')}`"
            for f in kind.fields
            if holds_text(f.dataType)
        )
        return f"struct({parts})"
    return text(value)


def mirror_type(kind: T.DataType, leaf: T.DataType) -> T.DataType:
    """The type of ``mirror`` with ``leaf`` in place of its texts."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(mirror_type(kind.elementType, leaf))
    if isinstance(kind, T.MapType):
        return T.ArrayType(mirror_type(kind.valueType, leaf))
    if isinstance(kind, T.StructType):
        return T.StructType(
            [T.StructField(f.name, mirror_type(f.dataType, leaf)) for f in kind.fields if holds_text(f.dataType)]
        )
    return leaf
