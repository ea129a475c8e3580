"""Splitting a long text into byte-bounded chunks, in-row and JVM-side.

A chunk is ``struct<text, sep, start>``: its text, the separator that follows it
in the original, and its first character's position in the original.  Lines are
packed greedily; a line that is longer than the limit is cut behind the last white space
that fits or, where there is none, at the largest prefix, never inside a character.

``parity=False`` (default) is lossless: ``text`` and ``sep`` of all chunks joined
give the original back, and every chunk respects the limit.  ``parity=True``
reproduces the observed behaviour of the original tool: blank lines at the start
of a chunk vanish, a long line behind a non-empty chunk stays whole, lines are cut at
the largest prefix, and chunks are always joined by a line feed, also where a line was
cut.
"""

from __future__ import annotations

from hushframe.functions.patterns import CHUNK_BYTES, HALO_BYTES
from hushframe.functions.sqltext import (
    Sql,
    aggregate,
    empty,
    let,
    lit,
    scan,
    struct,
    transform,
    transform_indexed,
    when,
    zip_with,
)

_CHUNK = "struct<text:string,sep:string,start:int>"
_NEWLINE = "char(10)"
_NOTHING = "''"


def _cut_width(data: Sql, pos: Sql, limit: int) -> Sql:
    """Bytes to take at ``pos`` so that no character is split."""
    left = f"octet_length({data}) - {pos}"

    def starts_character(back: int) -> Sql:
        byte = f"substring({data}, {pos} + {limit - back + 1}, 1)"
        return f"NOT ({byte} >= X'80' AND {byte} <= X'BF')"

    return when(
        (f"{left} <= {limit}", left),
        (starts_character(0), str(limit)),
        (starts_character(1), str(limit - 1)),
        (starts_character(2), str(limit - 2)),
        other=str(limit - 3),
    )


_TO_SPACE = r"(?s)^.*[ \t\x0B\f\r]"


def cut_line(line: Sql, limit: int = CHUNK_BYTES, *, words: bool = True) -> Sql:
    """Pieces of one line: array<struct<text, sep, off>>, each within the limit.

    With ``words`` a piece ends behind white space where it holds any.  ``sep`` is a line feed on the last piece and empty on the others; ``off`` is
    the piece's character position in the line.
    """

    def pieces(data: Sql) -> Sql:
        size = f"octet_length({data})"
        # Two pieces in a row hold at least limit - 3 bytes, which bounds the steps.
        steps = f"sequence(1, cast(2 * ceil({size} / {limit - 3}) AS int))"

        def take(state: Sql, _: Sql) -> Sql:
            def behind_space(text: Sql) -> Sql:
                head = f"regexp_extract({text}, {lit(_TO_SPACE)}, 0)"
                more = f"{state}.pos + octet_length({text}) < {size}"
                return let(
                    when((more, head), other="''"),
                    lambda h: f"octet_length({when((f'{h} <> ' + _NOTHING, h), other=text)})",
                )

            width = _cut_width(data, f"{state}.pos", limit)
            if words:
                fits = let(width, lambda w: f"cast(substring({data}, {state}.pos + 1, {w}) AS string)")
                width = let(fits, behind_space)
            cut = let(
                f"{state}.pos + {width}", lambda end: struct(ends=f"array_append({state}.ends, {end})", pos=end)
            )
            return when((f"{state}.pos >= {size}", state), other=cut)

        # A fold copies its state at every step, so it holds places only, no texts.
        ends = aggregate(steps, struct(ends=empty("int"), pos="0"), take, lambda s: f"{s}.ends")
        return let(ends, lambda es: let(texts(data, es), lambda ts: placed(ts)))

    def texts(data: Sql, ends: Sql) -> Sql:
        def text(end: Sql, i: Sql) -> Sql:
            before = f"coalesce(get({ends}, {i} - 1), 0)"
            return f"cast(substring({data}, {before} + 1, {end} - {before}) AS string)"

        return transform_indexed(ends, text)

    def placed(found: Sql) -> Sql:
        offs = scan(transform(found, lambda t: f"length({t})"), lambda a, b: f"{a} + {b}")

        def piece(t: Sql, off: Sql) -> Sql:
            return struct(text=t, sep=_NOTHING, off=off)

        return let(zip_with(found, offs, piece), closed)

    def closed(ps: Sql) -> Sql:
        last = struct(text=f"element_at({ps}, -1).text", sep=_NEWLINE, off=f"element_at({ps}, -1).off")
        return f"concat(slice({ps}, 1, size({ps}) - 1), array({last}))"

    return let(f"cast({line} AS binary)", pieces)


def _pack(text: Sql, limit: int) -> Sql:
    """Default packing: greedy over pieces, lossless."""
    pieces = transform(
        f"split({text}, {_NEWLINE}, -1)",
        lambda line: when(
            (f"octet_length({line}) > {limit}", cut_line(line, limit)),
            other=f"array({struct(text=line, sep=_NEWLINE, off='0')})",
        ),
    )

    def open_at(state: Sql, piece: Sql) -> Sql:
        """The places of pieces that open a chunk; ``size`` is that of the open chunk."""
        opens = f"({state}.at = 0 OR {state}.size + octet_length({piece}.text) > {limit})"
        own = f"octet_length({piece}.text) + octet_length({piece}.sep)"
        return struct(
            opening=when((opens, f"array_append({state}.opening, {state}.at)"), other=f"{state}.opening"),
            size=when((opens, own), other=f"{state}.size + {own}"),
            at=f"{state}.at + 1",
        )

    def joined(ps: Sql) -> Sql:
        zero = struct(opening=empty("int"), size="0", at="0")
        return let(
            aggregate(ps, zero, open_at, lambda s: f"{s}.opening"),
            lambda opening: let(transform_indexed(opening, lambda a, i: chunk(ps, opening, a, i)), started),
        )

    def chunk(ps: Sql, opening: Sql, a: Sql, i: Sql) -> Sql:
        end = f"coalesce(get({opening}, {i} + 1), size({ps}))"
        return let(
            f"slice({ps}, {a} + 1, {end} - {a})",
            lambda own: struct(
                text=f"concat(array_join({transform(f'slice({own}, 1, size({own}) - 1)', _whole)}, ''), "
                f"element_at({own}, -1).text)",
                sep=when((f"{end} = size({ps})", _NOTHING), other=f"element_at({own}, -1).sep"),
            ),
        )

    def started(cs: Sql) -> Sql:
        lengths = transform(cs, lambda c: f"length({c}.text) + length({c}.sep)")
        starts = scan(lengths, lambda a, b: f"{a} + {b}")
        return zip_with(cs, starts, lambda c, at: struct(text=f"{c}.text", sep=f"{c}.sep", start=at))

    return let(f"flatten({pieces})", joined)


def _whole(piece: Sql) -> Sql:
    return f"concat({piece}.text, {piece}.sep)"


def _pack_parity(text: Sql, limit: int) -> Sql:
    """Packing as observed in the original tool."""
    zero = struct(done=empty(_CHUNK), cur="''", start="0", pos="0")

    def push(state: Sql) -> Sql:
        chunk = struct(text=f"{state}.cur", sep=_NEWLINE, start=f"{state}.start")
        return f"array_append({state}.done, {chunk})"

    def add(state: Sql, line: Sql) -> Sql:
        blank = f"{state}.cur = ''"
        joined = when((blank, "0"), other=f"octet_length({state}.cur) + 1")
        over = f"octet_length({line}) + {joined} > {limit}"
        after = f"{state}.pos + length({line}) + 1"

        def cut(pieces: Sql) -> Sql:
            whole = f"slice({pieces}, 1, size({pieces}) - 1)"
            rest = f"element_at({pieces}, -1)"
            pushed = transform(
                whole,
                lambda x: struct(
                    text=f"{x}.text", sep=_NEWLINE, start=f"{state}.pos + {x}.off"
                ),
            )
            return struct(
                done=f"concat({state}.done, {pushed})",
                cur=f"{rest}.text",
                start=f"{state}.pos + {rest}.off",
                pos=after,
            )

        opened = {"cur": line, "start": f"{state}.pos", "pos": after}
        return when(
            (f"{over} AND NOT {blank}", struct(done=push(state), **opened)),
            (over, let(cut_line(line, limit, words=False), cut)),
            (blank, struct(done=f"{state}.done", **opened)),
            other=struct(
                done=f"{state}.done",
                cur=f"concat({state}.cur, {_NEWLINE}, {line})",
                start=f"{state}.start",
                pos=after,
            ),
        )

    packed = aggregate(
        f"split({text}, {_NEWLINE}, -1)",
        zero,
        add,
        lambda s: when((f"{s}.cur <> ''", push(s)), other=f"{s}.done"),
    )
    # No separator behind the last chunk.
    return let(
        packed,
        lambda cs: transform_indexed(
            cs,
            lambda c, i: struct(
                text=f"{c}.text",
                sep=when((f"{i} = size({cs}) - 1", "''"), other=f"{c}.sep"),
                start=f"{c}.start",
            ),
        ),
    )


def chunk_text(text: Sql, limit: int = CHUNK_BYTES, *, parity: bool = False) -> Sql:
    """Chunks of a text: array<struct<text, sep, start>>; null for null."""
    if limit < 8:
        raise ValueError("limit must leave room for a multi-byte character")
    pack = _pack_parity if parity else _pack
    return when(
        (
            f"octet_length({text}) <= {limit}",
            f"array({struct(text=text, sep=_NOTHING, start='0')})",
        ),
        (f"{text} IS NOT NULL", pack(text, limit)),
    )


def reassemble(chunks: Sql) -> Sql:
    """Text of a chunk array: every chunk followed by its separator."""
    parts = transform(chunks, lambda c: f"concat({c}.text, {c}.sep)")
    return f"array_join({parts}, '')"


def _halo(text: Sql, side: str) -> Sql:
    """At most ``HALO_BYTES`` of a text from its left or right end."""
    return let(
        f"{side}({text}, {HALO_BYTES})",
        lambda h: when((f"octet_length({h}) <= {HALO_BYTES}", h), other=f"{side}({h}, {HALO_BYTES // 4})"),
    )


def with_halos(chunks: Sql) -> Sql:
    """Chunks with the ends of their neighbours, ``before`` and ``after``.

    Two neighbours on a side hold more than a chunk's limit together.
    """

    def with_neighbours(c: Sql, i: Sql) -> Sql:
        def whole(at: Sql) -> Sql:
            return f"coalesce(concat(get({chunks}, {at}).text, get({chunks}, {at}).sep), '')"

        before = f"concat({whole(f'{i} - 2')}, {whole(f'{i} - 1')})"
        after = f"concat({c}.sep, {whole(f'{i} + 1')}, {whole(f'{i} + 2')})"
        return struct(
            text=f"{c}.text", sep=f"{c}.sep", start=f"{c}.start",
            before=_halo(before, "right"), after=_halo(after, "left"),
        )

    return transform_indexed(chunks, with_neighbours)
