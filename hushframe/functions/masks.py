"""Pattern stage: five masks as native SQL expressions.

The masks run in a fixed order, each on the output of the one before.  All
functions here map the SQL text of a string expression to SQL text; they hold no
state, need no shuffle and no Python worker, and can be used at top level, inside
``transform`` and in streams alike.
"""

from __future__ import annotations

from collections.abc import Callable

from hushframe.functions import patterns as p
from hushframe.functions.sqltext import (
    Sql,
    empty,
    filter_,
    let,
    lit,
    struct,
    transform,
    transform_indexed,
    when,
    zip_with,
)

NO_TYPES = empty("string")

# --- credit cards -----------------------------------------------------------


def card_digits(match: Sql) -> Sql:
    return f"regexp_replace({match}, {lit('[^0-9]')}, '')"


def luhn_valid(number: Sql) -> Sql:
    """Luhn test over the digits of ``number``; everything else is ignored."""
    return f"luhn_check({card_digits(number)})"


def mask_card_match(match: Sql) -> Sql:
    """Mask of one card-shaped match; unchanged if the Luhn test fails."""
    sep = when(
        (f"contains({match}, '-')", "'-'"), (f"contains({match}, ' ')", "' '"), other="''"
    )
    masked = let(
        f"concat('****', {sep})", lambda g: f"concat({g}, {g}, {g}, right({match}, 4))"
    )
    return when((luhn_valid(match), masked), other=match)


def card_matches(text: Sql) -> Sql:
    return f"regexp_extract_all({text}, {lit(p.CREDIT_CARD)}, 0)"


def _untouched(text: Sql) -> Sql:
    return struct(value=text, n="0")


def _mask_cards(text: Sql) -> Sql:
    def rebuild(found: Sql) -> Sql:
        gaps = f"split({text}, {lit(p.CREDIT_CARD)}, -1)"
        # One gap more than matches: the last pair is (gap, null), and array_join
        # leaves nulls out.
        pieces = zip_with(gaps, found, lambda g, m: f"array({g}, {mask_card_match(m)})")
        return let(
            f"size({filter_(found, luhn_valid)})",
            lambda hits: struct(
                value=when(
                    (f"{hits} > 0", f"array_join(flatten({pieces}), '')"), other=text
                ),
                n=hits,
            ),
        )

    return when(
        (f"{text} RLIKE {lit(p.CREDIT_CARD_HINT)}", let(card_matches(text), rebuild)),
        other=_untouched(text),
    )


def _replacing(
    hint: Callable[[Sql], Sql], pattern: str, mask: str
) -> Callable[[Sql], Sql]:
    def step(text: Sql) -> Sql:
        return when(
            (
                hint(text),
                struct(
                    value=f"regexp_replace({text}, {lit(pattern)}, {lit(mask)})",
                    n=f"regexp_count({text}, {lit(pattern)})",
                ),
            ),
            other=_untouched(text),
        )

    return step


# Hint, pattern and mask of the kinds that are replaced by pattern alone.
_REPLACED = {
    "iban": (lambda t: f"{t} RLIKE {lit(p.IBAN_HINT)}", p.IBAN, p.IBAN_MASK),
    "ssn": (lambda t: f"{t} RLIKE {lit(p.SSN_HINT)}", p.SSN, p.SSN_MASK),
    "email": (lambda t: f"contains({t}, {lit(p.EMAIL_HINT)})", p.EMAIL, p.EMAIL_MASK),
    "phone": (lambda t: f"contains({t}, {lit(p.PHONE_HINT)})", p.PHONE, p.PHONE_MASK),
}


# Each step maps text to struct<value: string, n: int>.
MASKS: dict[str, Callable[[Sql], Sql]] = {
    "credit_card": _mask_cards,
    **{kind: _replacing(*parts) for kind, parts in _REPLACED.items()},
}


# --- all five ---------------------------------------------------------------


def may_hold_pii(text: Sql) -> Sql:
    """Cheap necessary condition for any of the five masks to change ``text``.

    If no pattern matches the raw text, nothing is replaced and so no later
    pattern can start to match: testing the raw text is enough.  Card, IBAN and
    SSN all hold two adjacent digits, which most prose does not.
    """
    return (
        f"(contains({text}, {lit(p.EMAIL_HINT)}) OR contains({text}, {lit(p.PHONE_HINT)})"
        f" OR ({text} RLIKE {lit(p.TWO_DIGITS)} AND {text} RLIKE {lit(p.DIGITS_HINT)}))"
    )


def _chain(text: Sql) -> Sql:
    """struct<value, credit_card, iban, ssn, email, phone>; the last five are counts."""

    def step(current: Sql, counts: list[Sql], left: list[str]) -> Sql:
        if not left:
            return struct(value=current, **dict(zip(p.PATTERN_TYPES, counts)))
        return let(
            MASKS[left[0]](current),
            lambda r: step(f"{r}.value", [*counts, f"{r}.n"], left[1:]),
        )

    return step(text, [], list(p.PATTERN_TYPES))


def mask_all(text: Sql) -> Sql:
    """Masked text and per-kind counts: struct<value, credit_card, ..., phone>."""
    nothing = struct(value=text, **{k: "0" for k in p.PATTERN_TYPES})
    return when((may_hold_pii(text), _chain(text)), other=nothing)


def total(masked: Sql) -> Sql:
    """Number of redactions in a ``mask_all`` result."""
    return "(" + " + ".join(f"{masked}.{k}" for k in p.PATTERN_TYPES) + ")"


def kinds(masked: Sql) -> Sql:
    """Kinds found in a ``mask_all`` result, in order of discovery."""
    found = ", ".join(when((f"{masked}.{k} > 0", lit(k))) for k in p.PATTERN_TYPES)
    return when(
        (f"{total(masked)} > 0", f"array_compact(array({found}))"), other=NO_TYPES
    )


def each_kind(masked: Sql) -> Sql:
    """Kinds of a ``mask_all`` result with one entry per redaction."""
    found = ", ".join(f"array_repeat({lit(k)}, {masked}.{k})" for k in p.PATTERN_TYPES)
    return when((f"{total(masked)} > 0", f"flatten(array({found}))"), other=NO_TYPES)


def counts(types: Sql) -> Sql:
    """map<kind, count> of a list with one entry per redaction."""
    return let(
        types,
        lambda all_: "map_from_entries("
        + transform(
            f"array_distinct({all_})",
            lambda k: f"struct({k}, size({filter_(all_, lambda x: f'{x} = {k}')}))",
        )
        + ")",
    )


def redact(text: Sql) -> Sql:
    """Pattern stage for one string: struct<value, n, types>.

    The form used inside lambdas; null stays null with a count of 0.  ``types`` has one
    entry per redaction.
    """
    hit = let(
        _chain(text),
        lambda r: struct(value=f"{r}.value", n=total(r), types=each_kind(r)),
    )
    return when(
        (may_hold_pii(text), hit), other=struct(value=text, n="0", types=NO_TYPES)
    )


# --- findings ---------------------------------------------------------------


def _masked_matches(text: Sql, kind: str) -> Sql:
    """Masks of the matches of one kind in that stage's input text.

    One scan under the kind's hint; the mask is made from the match.
    """

    def every(hint: Sql, pattern: str, mask: Callable[[Sql], Sql]) -> Sql:
        found = transform(f"regexp_extract_all({text}, {lit(pattern)}, 0)", mask)
        return when((hint, found), other="cast(array() AS array<string>)")

    if kind == "credit_card":
        found = transform(filter_(card_matches(text), luhn_valid), mask_card_match)
        return when((f"{text} RLIKE {lit(p.CREDIT_CARD_HINT)}", found), other="cast(array() AS array<string>)")
    if kind == "iban":
        return every(
            f"{text} RLIKE {lit(p.IBAN_HINT)}", p.IBAN,
            lambda m: f"concat(left({m}, 4), '****', right({m}, 4))",
        )
    if kind == "ssn":
        return every(f"{text} RLIKE {lit(p.SSN_HINT)}", p.SSN, lambda m: lit(p.SSN_MASK))
    if kind == "email":
        # Of a match that continues the one before only its first character is known to
        # begin it; the groups tell both kinds of start apart.
        parts = struct(
            a=f"regexp_extract_all({text}, {lit(p.EMAIL)}, 2)",
            b=f"regexp_extract_all({text}, {lit(p.EMAIL)}, 0)",
        )
        masked = let(
            parts,
            lambda r: zip_with(
                f"{r}.a", f"{r}.b",
                lambda a, m: f"concat(if({a} = '', left({m}, 1), {a}), '***@', substring_index({m}, '@', -1))",
            ),
        )
        return when((f"contains({text}, {lit(p.EMAIL_HINT)})", masked), other="cast(array() AS array<string>)")
    return every(
        f"contains({text}, {lit(p.PHONE_HINT)})", p.PHONE,
        lambda m: let(card_digits(m), lambda d: f"concat('+', left({d}, 2), '***', right({d}, 2))"),
    )


def _masked_text(text: Sql, kind: str) -> Sql:
    """The text behind one mask, for where its count is known otherwise."""
    if kind not in _REPLACED:
        return f"{MASKS[kind](text)}.value"
    hint, pattern, mask = _REPLACED[kind]
    return when((hint(text), f"regexp_replace({text}, {lit(pattern)}, {lit(mask)})"), other=text)


def findings(text: Sql) -> Sql:
    """array<struct<type, ordinal, masked>>: one element per masked match.

    Only masked values are returned, never the raw match.
    """

    def here(current: Sql, kind: str) -> Sql:
        return transform_indexed(
            _masked_matches(current, kind),
            lambda m, i: struct(type=lit(kind), ordinal=i, masked=m),
        )

    def step(current: Sql, found: list[Sql], left: list[str]) -> Sql:
        kind = left[0]
        if len(left) == 1:
            return f"concat({', '.join([*found, here(current, kind)])})"
        return let(
            struct(value=_masked_text(current, kind), here=here(current, kind)),
            lambda r: step(f"{r}.value", [*found, f"{r}.here"], left[1:]),
        )

    return step(text, [], list(p.PATTERN_TYPES))
