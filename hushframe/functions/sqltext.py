"""Helpers to write Spark SQL expressions as text.

The expressions of this package nest lambdas several levels deep.  As SQL text
each one reaches the JVM in a single ``F.expr`` call, where the same tree built
node by node from ``Column`` objects takes thousands of round trips.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

Sql = str

_ids = count()


def var(prefix: str = "v") -> str:
    """A lambda variable name not used before, so that no scope hides another."""
    return f"{prefix}_{next(_ids)}"


def lit(text: str) -> Sql:
    """String literal, taken as it is (no escapes)."""
    if "'" not in text:
        return f"r'{text}'"
    parts = (f"r'{part}'" for part in text.split("'"))
    return "concat(" + ", \"'\", ".join(parts) + ")"


def name(*parts: str) -> Sql:
    """Column or field reference."""
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def empty(kind: str) -> Sql:
    """Empty array of an element type."""
    return f"cast(array() AS array<{kind}>)"


def struct(**fields: Sql) -> Sql:
    return "struct(" + ", ".join(f"{v} AS `{k}`" for k, v in fields.items()) + ")"


def when(*cases: tuple[Sql, Sql], other: Sql = "NULL") -> Sql:
    inner = " ".join(f"WHEN {c} THEN {v}" for c, v in cases)
    return f"(CASE {inner} ELSE {other} END)"


def transform(array: Sql, body: Callable[[Sql], Sql]) -> Sql:
    x = var("x")
    return f"transform({array}, {x} -> {body(x)})"


def transform_indexed(array: Sql, body: Callable[[Sql, Sql], Sql]) -> Sql:
    x, i = var("x"), var("i")
    return f"transform({array}, ({x}, {i}) -> {body(x, i)})"


def filter_(array: Sql, body: Callable[[Sql], Sql]) -> Sql:
    x = var("x")
    return f"filter({array}, {x} -> {body(x)})"


def exists(array: Sql, body: Callable[[Sql], Sql]) -> Sql:
    x = var("x")
    return f"exists({array}, {x} -> {body(x)})"


def zip_with(left: Sql, right: Sql, body: Callable[[Sql, Sql], Sql]) -> Sql:
    a, b = var("a"), var("b")
    return f"zip_with({left}, {right}, ({a}, {b}) -> {body(a, b)})"


def transform_values(map_: Sql, body: Callable[[Sql, Sql], Sql]) -> Sql:
    k, v = var("k"), var("v")
    return f"transform_values({map_}, ({k}, {v}) -> {body(k, v)})"


def aggregate(
    array: Sql,
    zero: Sql,
    merge: Callable[[Sql, Sql], Sql],
    finish: Callable[[Sql], Sql] | None = None,
) -> Sql:
    s, x = var("s"), var("x")
    tail = ""
    if finish is not None:
        f = var("f")
        tail = f", {f} -> {finish(f)}"
    return f"aggregate({array}, {zero}, ({s}, {x}) -> {merge(s, x)}{tail})"


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """Evaluate ``value`` once and use the result several times in ``body``.

    Inside a lambda there is no projection to hold an intermediate result, so a
    one-element array stands in for it.  Without this, five chained
    (count, replace) pairs would copy the expression tree 2**5 times.
    """
    v = var("v")
    return f"transform(array({value}), {v} -> {body(v)})[0]"


# Elements of a block of ``scan``.
_BLOCK = 64


def scan(numbers: Sql, op: Callable[[Sql, Sql], Sql], zero: str = "0") -> Sql:
    """For each number, ``op`` over all before it.

    A fold copies its state at every step, so one that collects n items costs n squared.
    Here blocks are folded, then their totals, and each block is shifted by the total
    before it.
    """

    def folded(values: Sql) -> Sql:
        start = struct(acc=zero, out=empty("int"))
        step = lambda s, x: struct(acc=op(f"{s}.acc", x), out=f"array_append({s}.out, {s}.acc)")
        return aggregate(values, start, step)

    def joined(blocks: Sql) -> Sql:
        return let(
            folded(f"{blocks}.acc"),
            lambda carry: f"flatten({zip_with(f'{blocks}.out', f'{carry}.out', shifted)})",
        )

    def shifted(out: Sql, before: Sql) -> Sql:
        return transform(out, lambda v: op(before, v))

    def blocks(values: Sql) -> Sql:
        starts = f"sequence(0, (size({values}) - 1) div {_BLOCK})"
        parts = transform(starts, lambda b: folded(f"slice({values}, cast({b} AS int) * {_BLOCK} + 1, {_BLOCK})"))
        return when((f"size({values}) > 0", let(parts, joined)), other=empty("int"))

    return let(numbers, blocks)
