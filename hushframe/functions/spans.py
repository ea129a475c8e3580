"""Entity stage: replacing spans found by a detector with typed placeholders.

Spans are ``struct<type, begin, end>`` with character offsets relative to their
chunk, end exclusive.  Functions map SQL text to SQL text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from hushframe.functions.chunks import chunk_text
from hushframe.functions.masks import NO_TYPES
from hushframe.functions.patterns import CHUNK_BYTES, ENTITY_TYPES
from hushframe.functions.sqltext import (
    Sql,
    aggregate,
    empty,
    exists,
    filter_,
    let,
    lit,
    scan,
    struct,
    transform,
    transform_indexed,
    when,
    zip_with,
)

SPAN = "struct<type:string,begin:int,end:int>"
NO_SPANS = empty(SPAN)


def _span(s: Sql) -> Sql:
    return struct(type=f"{s}.type", begin=f"{s}.begin", end=f"{s}.`end`")


def allowed_types(types: Sequence[str] | None = None) -> Sql:
    """Entity kinds to redact, as an array."""
    return f"array({', '.join(lit(t) for t in (ENTITY_TYPES if types is None else types))})"


def is_relevant(type_: Sql, begin: Sql, end: Sql, allowed: Sql) -> Sql:
    """Kind on the allow-list and both offsets known."""
    return (
        f"coalesce(array_contains({allowed}, {type_}) AND {begin} IS NOT NULL"
        f" AND {end} IS NOT NULL, false)"
    )


def relevant_spans(spans: Sql, allowed: Sql) -> Sql:
    return filter_(
        spans, lambda s: is_relevant(f"{s}.type", f"{s}.begin", f"{s}.`end`", allowed)
    )


def spans_desc(spans: Sql) -> Sql:
    """Stable sort by begin, last span first; ties keep their order.

    Sorting structs led by (-begin, position) uses the natural order and needs no
    comparator lambda.
    """
    keyed = transform_indexed(
        spans,
        lambda s, i: struct(
            key=f"-{s}.begin",
            ordinal=i,
            type=f"{s}.type",
            begin=f"{s}.begin",
            end=f"{s}.`end`",
        ),
    )
    return f"array_sort({keyed})"


def apply_spans(text: Sql, ordered: Sql) -> Sql:
    """Replace spans in the given (descending) order by ``[REDACTED:TYPE]``.

    Overlapping spans are spliced with their original offsets, as observed in the
    original tool; ``united_spans`` leaves none.
    """
    return aggregate(
        ordered,
        text,
        lambda t, s: (
            f"concat(substring({t}, 1, {s}.begin), '[REDACTED:', {s}.type, ']',"
            f" substring({t}, {s}.`end` + 1, length({t})))"
        ),
    )


def united_spans(spans: Sql, size: Sql) -> Sql:
    """Spans in ascending order, overlapping ones as one of the kind that begins first.

    Ends are cut to the ``size`` of the text; spans that end before they begin drop out.
    """

    def keyed(n: Sql) -> Sql:
        inside = filter_(spans, lambda s: f"{s}.`end` >= {s}.begin AND {s}.begin >= 0 AND {s}.begin <= {n}")
        return transform_indexed(
            inside,
            lambda s, i: struct(begin=f"{s}.begin", ordinal=i, type=f"{s}.type", end=f"least({s}.`end`, {n})"),
        )

    def heads(ks: Sql) -> Sql:
        # A span begins a placeholder if all before it have ended.
        ends = scan(f"{ks}.`end`", lambda a, b: f"greatest({a}, {b})")
        paired = zip_with(ks, ends, lambda k, e: struct(type=f"{k}.type", begin=f"{k}.begin", after=e))
        first = filter_(paired, lambda h: f"{h}.begin >= {h}.after")
        return let(first, lambda hs: transform_indexed(hs, lambda h, i: whole(ks, hs, h, i)))

    def whole(ks: Sql, hs: Sql, h: Sql, i: Sql) -> Sql:
        end = f"coalesce(get({hs}, {i} + 1).after, array_max({ks}.`end`))"
        return struct(type=f"{h}.type", begin=f"{h}.begin", end=end)

    # Unlike array_sort, sort_array compares without a lambda. Ordinals leave no ties.
    return let(f"sort_array({let(size, keyed)})", heads)


def splice_spans(text: Sql, united: Sql) -> Sql:
    """Replace ``united_spans`` of a text by ``[REDACTED:TYPE]``, each part of it cut out once.

    ASCII text is cut as a binary, which takes time by the length of the cut; cutting a
    string takes time by the length of the whole.
    """

    def spliced(cut: Callable[[Sql, Sql], Sql]) -> Sql:
        def part(s: Sql, i: Sql) -> Sql:
            return let(
                f"coalesce(get({united}, {i} - 1).`end`, 0)",
                lambda at: f"concat({cut(f'{at} + 1', f'{s}.begin - {at}')}, '[REDACTED:', {s}.type, ']')",
            )

        tail = cut(f"element_at({united}, -1).`end` + 1", f"octet_length({text})")
        return f"concat(array_join({transform_indexed(united, part)}, ''), {tail})"

    def of_bytes(data: Sql) -> Sql:
        return spliced(lambda pos, n: f"cast(substring({data}, {pos}, {n}) AS string)")

    return when(
        (f"octet_length({text}) = length({text})", let(f"cast({text} AS binary)", of_bytes)),
        other=spliced(lambda pos, n: f"substring({text}, {pos}, {n})"),
    )


def redact_chunks(text: Sql, chunks: Sql, spans: Sql, allowed: Sql) -> Sql:
    """Entity stage for one text: struct<value, n, types>.

    ``spans`` is an array of span arrays, one per chunk.  Kinds come in order of
    discovery: by chunk, and within a chunk from the last span to the first.
    """

    def per_chunk(chunk: Sql, found: Sql) -> Sql:
        return let(
            spans_desc(relevant_spans(f"coalesce({found}, {NO_SPANS})", allowed)),
            lambda ss: struct(
                text=when(
                    (f"size({ss}) > 0", apply_spans(f"{chunk}.text", ss)),
                    other=f"{chunk}.text",
                ),
                sep=f"{chunk}.sep",
                n=f"size({ss})",
                types=transform(ss, lambda s: f"{s}.type"),
            ),
        )

    def collect(done: Sql) -> Sql:
        joined = transform(done, lambda c: f"concat({c}.text, {c}.sep)")
        return struct(
            value=f"array_join({joined}, '')",
            n=aggregate(done, "0", lambda n, c: f"{n} + {c}.n"),
            types=f"flatten({done}.types)",
        )

    return when(
        (exists(spans, lambda ss: f"size({ss}) > 0"), let(zip_with(chunks, spans, per_chunk), collect)),
        other=struct(value=text, n="0", types=NO_TYPES),
    )


# Put around each match; a Unicode noncharacter, reserved for use inside a program.
_MARK = "\ufdd0"


def _marked(text: Sql, pattern: str) -> Sql:
    """A text's gaps and matches in turn, beginning and ending with a gap, by one scan.

    A text that holds the mark itself is scanned for its matches and for its gaps.
    """
    marked = f"split(regexp_replace({text}, {lit(pattern)}, {lit(_MARK + '$0' + _MARK)}), {lit(_MARK)}, -1)"
    pairs = zip_with(
        f"split({text}, {lit(pattern)}, -1)",
        f"regexp_extract_all({text}, {lit(pattern)}, 0)",
        lambda g, m: f"array_compact(array({g}, {m}))",
    )
    return when((f"contains({text}, {lit(_MARK)})", f"flatten({pairs})"), other=marked)


def pattern_spans(text: Sql, pattern: str, type_: str) -> Sql:
    """Spans of every match of a Java pattern: array<struct<type, begin, end>>.

    Offsets follow from the lengths of the matches and of the gaps between them.
    """

    def locate(parts: Sql) -> Sql:
        pairs = transform(
            f"sequence(0, size({parts}) - 3, 2)",
            lambda i: struct(gap=f"length(get({parts}, {i}))", width=f"length(get({parts}, {i} + 1))"),
        )
        return when((f"size({parts}) > 1", let(pairs, placed)), other=NO_SPANS)

    def placed(ps: Sql) -> Sql:
        before = scan(transform(ps, lambda p: f"{p}.gap + {p}.width"), lambda a, b: f"{a} + {b}")
        return zip_with(
            before,
            ps,
            lambda b, p: struct(type=lit(type_), begin=f"{b} + {p}.gap", end=f"{b} + {p}.gap + {p}.width"),
        )

    return let(_marked(text, pattern), locate)


# --- matches of a whole text ---------------------------------------------------

def _places(rule: Sql) -> Sql:
    """Byte places of the matches of one rule: array<struct<begin, rank, end>>.

    ``rule`` has its ``rank``, its ``matches`` and the ``gaps`` between them. In bytes, as
    cutting a binary takes time by the length of the cut, cutting a string by its place.
    """
    pairs = zip_with(
        f"slice({rule}.gaps, 1, size({rule}.matches))",
        f"{rule}.matches",
        lambda g, m: struct(gap=f"octet_length({g})", width=f"octet_length({m})"),
    )

    def placed(ps: Sql) -> Sql:
        before = scan(transform(ps, lambda p: f"{p}.gap + {p}.width"), lambda a, b: f"{a} + {b}")
        begin = lambda b, p: f"{b} + {p}.gap"
        return zip_with(
            before, ps, lambda b, p: struct(begin=begin(b, p), rank=f"{rule}.rank", end=f"{begin(b, p)} + {p}.width")
        )

    return let(pairs, placed)


def redact_matches(text: Sql, rules: Sequence[tuple[str, str, str]], allowed: Sql) -> Sql:
    """All matches of ``(kind, pattern, hint)`` rules in a text: struct<value, n, types>.

    Rules of kinds that are not allowed are not looked for, so they hide nothing. Each other
    rule whose hint holds is matched over the whole text by itself, in two scans. Where only
    one rule matches, the text is joined again from gaps and placeholders. Else what
    overlapping matches cover together becomes one placeholder, of the kind that begins
    first, and of two that begin together that of the earlier rule. Kinds come one per
    placeholder, from the last to the first.
    """
    kinds = f"array({', '.join(lit(r[0]) for r in rules)})"

    def wanted(kind: str, pattern: str, hint: str) -> Sql:
        # A hint that is the pattern itself would only scan the text once more.
        hinted = f" AND {text} RLIKE {lit(hint)}" if hint != pattern else ""
        return f"array_contains({allowed}, {lit(kind)}){hinted}"

    found = {
        f"m{i}": when(
            (wanted(kind, pattern, hint), f"regexp_extract_all({text}, {lit(pattern)}, 0)"), other=empty("string")
        )
        for i, (kind, pattern, hint) in enumerate(rules)
    }

    def alone(matches: Sql, kind: str, pattern: str) -> Sql:
        return struct(
            value=f"array_join(split({text}, {lit(pattern)}, -1), {lit(f'[REDACTED:{kind}]')})",
            n=f"size({matches})",
            types=f"array_repeat({lit(kind)}, size({matches}))",
        )

    def together(ms: Sql) -> Sql:
        scanned = ", ".join(
            struct(
                rank=str(i),
                matches=f"{ms}.m{i}",
                gaps=when((f"size({ms}.m{i}) > 0", f"split({text}, {lit(pattern)}, -1)"), other=empty("string")),
            )
            for i, (_, pattern, _) in enumerate(rules)
        )
        placed = f"flatten({transform(f'array({scanned})', _places)})"

        def heads(x: Sql) -> Sql:
            # A place begins a placeholder if all before it have ended.
            ends = scan(f"{x}.ps.`end`", lambda a, b: f"greatest({a}, {b})")
            paired = zip_with(
                f"{x}.ps", ends, lambda p, e: struct(begin=f"{p}.begin", rank=f"{p}.rank", after=e)
            )
            first = filter_(paired, lambda h: f"{h}.begin >= {h}.after")
            return let(first, lambda hs: joined(hs, f"{x}.data", f"array_max({x}.ps.`end`)"))

        return let(struct(ps=f"array_sort({placed})", data=f"cast({text} AS binary)"), heads)

    def joined(hs: Sql, data: Sql, end: Sql) -> Sql:
        parts = transform(
            hs,
            lambda h: f"concat(cast(substring({data}, {h}.after + 1, {h}.begin - {h}.after) AS string), "
            f"'[REDACTED:', {kinds}[{h}.rank], ']')",
        )
        tail = f"cast(substring({data}, {end} + 1, octet_length({data})) AS string)"
        return struct(
            value=f"concat(array_join({parts}, ''), {tail})",
            n=f"size({hs})",
            types=f"reverse({transform(hs, lambda h: f'{kinds}[{h}.rank]')})",
        )

    def choose(ms: Sql) -> Sql:
        none = [f"size({ms}.m{i}) = 0" for i in range(len(rules))]
        cases = [(" AND ".join(none), struct(value=text, n="0", types=NO_TYPES))]
        for i, (kind, pattern, _) in enumerate(rules):
            others = none[:i] + none[i + 1 :]
            cases.append((" AND ".join(others) or "true", alone(f"{ms}.m{i}", kind, pattern)))
        return when(*cases, other=together(ms) if len(rules) > 1 else "NULL")

    return let(struct(**found), choose)


# --- spans of a whole row -----------------------------------------------------
#
# All spans of one row from a joined table travel in a flat array of "hits", whether
# the row is one text or a record. This is the observed behaviour, chunk by chunk; else
# hits are applied to whole texts (``detectors.apply_hits``).

HIT = "struct<path:string,chunk_idx:int,ordinal:int,type:string,begin:int,end:int>"
NO_HITS = empty(HIT)


def hits_leaf(
    hits: Sql, allowed: Sql, *, limit: int = CHUNK_BYTES, parity: bool = False
) -> Callable[[Sql, Sql], Sql]:
    """Leaf function of the walk that applies a row's hits to its texts."""

    def spans_of(own: Sql, index: Sql) -> Sql:
        keyed = transform(
            filter_(own, lambda h: f"{h}.chunk_idx = {index}"),
            lambda h: struct(ordinal=f"{h}.ordinal", span=_span(h)),
        )
        return f"array_sort({keyed}).span"

    def leaf(text: Sql, path: Sql) -> Sql:
        nothing = struct(value=text, n="0", types=NO_TYPES, entity_types=NO_TYPES)

        def apply(own: Sql) -> Sql:
            redacted = let(
                chunk_text(text, limit, parity=parity),
                lambda cs: redact_chunks(
                    text,
                    cs,
                    transform_indexed(cs, lambda c, i: spans_of(own, i)),
                    allowed,
                ),
            )
            return let(
                redacted,
                lambda r: struct(
                    value=f"{r}.value",
                    n=f"{r}.n",
                    types=NO_TYPES,
                    entity_types=f"{r}.types",
                ),
            )

        # The path is bound first: in the filter it would be built for every hit.
        own = let(path, lambda p: filter_(hits, lambda h: f"{h}.path = {p}"))
        return when(
            (
                f"size({hits}) > 0",
                let(
                    own, lambda o: when((f"size({o}) > 0", apply(o)), other=nothing)
                ),
            ),
            other=nothing,
        )

    return leaf
