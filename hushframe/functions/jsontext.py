"""Document mode for JSON text of unknown schema.

The string literals of the document are found natively, those that are values
(not keys) are decoded, redacted and encoded again, and everything between them
is copied.  There is no schema to infer, so no extra pass over the data; numbers,
nulls, key order and mixed-type fields stay exactly as written.
"""

from __future__ import annotations

from collections.abc import Callable

from hushframe.functions.masks import NO_TYPES, may_hold_pii, redact
from hushframe.functions.sqltext import (
    Sql,
    aggregate,
    exists,
    let,
    lit,
    scan,
    struct,
    transform,
    transform_indexed,
    when,
    zip_with,
)

# Stand-ins for the two escapes that matter for finding the end of a literal.
# Both are Unicode noncharacters, reserved for use inside a program.  Should the
# document hold one, it is first written as its JSON escape, which is the same
# document.
_QUOTE = "\ufdd0"
_BACKSLASH = "\ufdd1"

_LITERAL = '"[^"]*"'
_KEY_AHEAD = r"^[ \t\r\n]*:"


def _replace(text: Sql, old: str, new: str) -> Sql:
    return f"replace({text}, {lit(old)}, {lit(new)})"


def _hide_escapes(text: Sql) -> Sql:
    for char in (_QUOTE, _BACKSLASH):
        text = _replace(text, char, f"\\u{ord(char):04x}")
    return _replace(_replace(text, "\\\\", _BACKSLASH), '\\"', _QUOTE)


def _show_escapes(text: Sql) -> Sql:
    return _replace(_replace(text, _QUOTE, '\\"'), _BACKSLASH, "\\\\")


def _decode(literal: Sql) -> Sql:
    """String value of a JSON string literal (escapes hidden)."""
    escaped = " OR ".join(
        f"contains({literal}, {lit(c)})" for c in ("\\", _QUOTE, _BACKSLASH)
    )
    parsed = (
        f"from_json(concat('[', {_show_escapes(literal)}, ']'), 'array<string>')[0]"
    )
    return when(
        (escaped, parsed), other=f"substring({literal}, 2, length({literal}) - 2)"
    )


def _encode(text: Sql) -> Sql:
    """JSON string literal of a value (escapes hidden)."""
    return let(
        f"to_json(array({text}))",
        lambda w: _hide_escapes(f"substring({w}, 2, length({w}) - 2)"),
    )


Stage = Callable[[Sql], Sql]  # text -> struct<value, n, types, entity_types>


def pattern_stage(text: Sql) -> Sql:
    return let(
        redact(text),
        lambda r: struct(value=f"{r}.value", n=f"{r}.n", types=f"{r}.types", entity_types=NO_TYPES),
    )


def _redact_literal(literal: Sql, after: Sql, stage: Stage) -> Sql:
    nothing = struct(value=literal, n="0", types=NO_TYPES, entity_types=NO_TYPES)
    redacted = lambda text: let(
        stage(text),
        lambda r: struct(
            value=when((f"{r}.n > 0", _encode(f"{r}.value")), other=literal),
            n=f"{r}.n",
            types=f"{r}.types",
            entity_types=f"{r}.entity_types",
        ),
    )
    # Null where the parser gives up on a literal, as on one of more than 20 MB.
    hit = let(_decode(literal), lambda text: when((f"{text} IS NOT NULL", redacted(text))))
    return when((f"{after} RLIKE {lit(_KEY_AHEAD)}", nothing), other=hit)


# What is left of a document has its literals written as one mark, and every other value,
# and every array or object that has been accepted, as another.
_LITERAL_MARK = "\ufdd2"
_VALUE_MARK = "\ufdd3"
_VALUE = r"true|false|null|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_ANY = f"[{_LITERAL_MARK}{_VALUE_MARK}]"
_PAIR = f"{_LITERAL_MARK}:{_ANY}"
# An array or object that holds no other. Possessive, so that no repetition recurses.
_FLAT = rf"\{{(?:{_PAIR}(?:,{_PAIR})*+)?+\}}|\[(?:{_ANY}(?:,{_ANY})*+)?+\]"
# Levels that are replaced one by one before the depth of what is left is counted.
_ROUNDS = 4
# What no string literal may hold: control characters, unknown escapes (``\\\\`` and ``\\"``
# are hidden).
_BAD_LITERAL = r"[\x00-\x1F]|\\(?![/bfnrt]|u[0-9a-fA-F]{4})"


def _is_document(doc: Sql) -> Sql:
    """Whether gaps and literals are those of a JSON text, as its grammar has it.

    Alike at any length and depth: after a few rounds that replace innermost arrays and
    objects by a value, what is left is sorted by depth, see ``_accepted``.
    """
    marks = f"[{_LITERAL_MARK}{_VALUE_MARK}]"
    skeleton = f"regexp_replace(array_join({doc}.gaps, {lit(_LITERAL_MARK)}), {lit(_VALUE)}, {lit(_VALUE_MARK)})"
    skeleton = f"regexp_replace({skeleton}, {lit('[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n]++')}, '')"
    for _ in range(_ROUNDS):
        skeleton = f"regexp_replace({skeleton}, {lit(_FLAT)}, {lit(_VALUE_MARK)})"
    accepted = let(
        skeleton, lambda s: when((f"length({s}) <= 1", f"{s} RLIKE {lit('^' + _ANY + '$')}"), other=_accepted(s))
    )
    foreign = f"array_join({doc}.gaps, '') RLIKE {lit(marks)}"
    bad = exists(f"{doc}.literals", lambda x: f"{x} RLIKE {lit(_BAD_LITERAL)}")
    return f"({accepted} AND NOT {foreign} AND NOT {bad})"


def _accepted(skeleton: Sql) -> Sql:
    """Whether marks, brackets, commas and colons are nested and placed as in JSON.

    Each character is put at the depth of the array or object it belongs to, and each of
    these, as a value, also at the depth around it. Sorted by depth, in the order of the
    text, the characters then spell one array or object after the other, none with another
    inside, which a pattern can judge.
    """

    def put(chars: Sql) -> Sql:
        steps = transform(chars, lambda c: when((f"{c} IN ('{{', '[')", "1"), (f"{c} IN ('}}', ']')", "-1"), other="0"))
        depths = scan(steps, lambda a, b: f"{a} + {b}")
        at = zip_with(chars, depths, lambda c, d: struct(c=c, d=d))
        return f"flatten({transform_indexed(at, placed)})"

    def placed(x: Sql, i: Sql) -> Sql:
        def item(depth: Sql, c: Sql) -> Sql:
            return struct(depth=depth, place=i, c=c)

        own = item(f"{x}.d", f"{x}.c")
        opened = f"array({item(f'{x}.d', lit(_VALUE_MARK))}, {item(f'{x}.d + 1', f'{x}.c')})"
        return when((f"{x}.c IN ('{{', '[')", opened), other=f"array({own})")

    spelled = let(
        f"regexp_extract_all({skeleton}, {lit('(?s).')}, 0)", lambda cs: f"array_join(array_sort({put(cs)}).c, '')"
    )
    return f"{spelled} RLIKE {lit(f'^{_ANY}(?:{_FLAT})*+$')}"


def _redact_document(text: Sql, stage: Stage, valid: bool = False) -> Sql:
    """struct<value, n, types, entity_types>; null where the text is no document.

    ``valid`` text is known to be one.
    """

    def split(hidden: Sql) -> Sql:
        return let(
            struct(
                gaps=f"split({hidden}, {lit(_LITERAL)}, -1)",
                literals=f"regexp_extract_all({hidden}, {lit(_LITERAL)}, 0)",
            ),
            lambda doc: redact_values(doc) if valid else when((_is_document(doc), redact_values(doc))),
        )

    def redact_values(doc: Sql) -> Sql:
        # The gap behind a literal tells a key from a value.
        followed = zip_with(
            f"{doc}.literals",
            f"slice({doc}.gaps, 2, size({doc}.gaps))",
            lambda x, after: _redact_literal(x, after, stage),
        )
        lost = lambda r: f"{r} IS NULL"
        return let(followed, lambda rs: when((f"NOT {exists(rs, lost)}", collect(doc, rs))))

    def collect(doc: Sql, rs: Sql) -> Sql:
        pieces = zip_with(f"{doc}.gaps", rs, lambda g, r: f"array({g}, {r}.value)")
        joined = _show_escapes(f"array_join(flatten({pieces}), '')")
        return let(
            aggregate(rs, "0", lambda a, r: f"{a} + {r}.n"),
            lambda n: struct(
                value=when((f"{n} > 0", joined), other=text),
                n=n,
                types=f"flatten({rs}.types)",
                entity_types=f"flatten({rs}.entity_types)",
            ),
        )

    return let(_hide_escapes(text), split)


def pattern_hint(text: Sql) -> Sql:
    """Whether the pattern stage may change a value of a document, told from its text.

    Escapes that can stand for a character of the five patterns: any ``\\u``, and white
    space behind a digit.
    """
    return (
        f"({may_hold_pii(text)} OR contains({text}, {lit(chr(92) + 'u')})"
        f" OR {text} RLIKE {lit('[0-9]' + chr(92) * 2 + '[tnrf]')})"
    )


def any_escape(hint: Stage) -> Stage:
    """A hint over the text of values as one over the text of a document, whose escapes
    may stand for any character."""
    return lambda text: f"(contains({text}, {lit(chr(92))}) OR {hint(text)})"


def redact_json_text(
    text: Sql, stage: Stage = pattern_stage, hint: Stage = pattern_hint, *, valid: bool = False
) -> Sql:
    """struct<value, n, types, entity_types> of a JSON document; text that is not JSON is
    redacted as plain text.

    ``stage`` redacts one text, ``hint`` is a cheap condition on the whole document for it
    to change anything. Text that Spark itself wrote is ``valid``: its grammar isn't tested.
    """
    nothing = struct(value=text, n="0", types=NO_TYPES, entity_types=NO_TYPES)
    return when((hint(text), f"coalesce({_redact_document(text, stage, valid)}, {stage(text)})"), other=nothing)
