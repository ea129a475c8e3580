"""Entity detectors.

``PatternDetector`` is a native expression over whole texts.  ``BatchDetector`` runs
user Python on Arrow batches, with one client per task; its texts are cut to windows
that a client can take. Windows overlap at every cut, and a span counts once, in the
window that owns its first character.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.chunks import chunk_text
from hushframe.functions.masks import NO_TYPES
from hushframe.functions.nested import mirror_type
from hushframe.functions.patterns import CHUNK_BYTES, HALO_BYTES, LEFT, RIGHT
from hushframe.functions.spans import NO_SPANS, pattern_spans, redact_matches
from hushframe.functions.sqltext import Sql, aggregate, let, lit, struct, transform, when

Span = tuple[str, int, int]
Client = Callable[[Sequence[str]], Iterable[Iterable[Span]]]

# Windows that a client is asked about at once.
GROUP = 256


class PatternDetector:
    """Native detector: every match of a Java pattern is an entity of one kind."""

    def __init__(self, type_: str, pattern: str, hint: str | None = None):
        self.type_ = type_
        self.pattern = pattern
        self.hint = hint or pattern

    def may_match(self, text: Sql) -> Sql:
        """Cheap necessary condition; texts that fail it are never chunked."""
        return f"{text} RLIKE {lit(self.hint)}"

    @property
    def rules(self) -> list[tuple[str, str, str]]:
        return [(self.type_, self.pattern, self.hint)]

    def spans_of(self, text: Sql) -> Sql:
        return when(
            (self.may_match(text), pattern_spans(text, self.pattern, self.type_)),
            other=NO_SPANS,
        )

    def redacted(self, text: Sql, allowed: Sql, *, limit: int = CHUNK_BYTES, parity: bool = False) -> Sql:
        """struct<value, n, types> of a text with the matches of allowed kinds replaced.

        The text is read as a whole; only ``parity`` reads it chunk by chunk and joins
        the chunks as the original tool did.
        """
        hit = redact_matches(text, self.rules, allowed)
        nothing = struct(value=text, n="0", types=NO_TYPES)
        if not parity:
            # Each rule tests its own hint.
            return when((f"{text} IS NOT NULL", hit), other=nothing)
        hit = let(
            transform(
                chunk_text(text, limit, parity=True),
                lambda c: let(
                    redact_matches(f"{c}.text", self.rules, allowed),
                    lambda r: struct(text=f"concat({r}.value, {c}.sep)", n=f"{r}.n", types=f"{r}.types"),
                ),
            ),
            lambda rs: struct(
                value=when(
                    (aggregate(rs, "0", lambda n, r: f"{n} + {r}.n") + " > 0", f"array_join({rs}.text, '')"),
                    other=text,
                ),
                n=aggregate(rs, "0", lambda n, r: f"{n} + {r}.n"),
                types=f"flatten({rs}.types)",
            ),
        )
        return when((self.may_match(text), hit), other=nothing)


class AnyDetector(PatternDetector):
    """Several native detectors side by side; spans come detector by detector."""

    def __init__(self, *detectors: PatternDetector):
        self.detectors = detectors

    @property
    def rules(self) -> list[tuple[str, str, str]]:
        return [r for d in self.detectors for r in d.rules]

    def may_match(self, text: Sql) -> Sql:
        return "(" + " OR ".join(d.may_match(text) for d in self.detectors) + ")"

    def spans_of(self, text: Sql) -> Sql:
        return f"concat({', '.join(d.spans_of(text) for d in self.detectors)})"


def ip_detector() -> PatternDetector:
    """The bundled rule: four dotted groups of one to three digits."""
    return PatternDetector(
        "IP_ADDRESS",
        LEFT + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + RIGHT,
        hint=r"[0-9]\.[0-9]{1,3}\.[0-9]",
    )


def windows(text: str, limit: int = CHUNK_BYTES) -> list[tuple[int, int, int, int]]:
    """Windows of a text for a client: begin, end, and the part of it that each owns.

    The owned parts follow each other without a gap. They end behind a line, else behind
    white space, else anywhere. A window shows up to ``HALO_BYTES`` more on each side (an
    eighth of the limit, if that is less) and holds at most ``limit`` UTF-8 bytes.
    """
    n = len(text)
    if text.isascii():
        size = np.arange(n + 1)
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        size = np.concatenate(([0], np.cumsum(width)))
    halo = min(HALO_BYTES, limit // 8)
    out, at = [], 0
    while at < n or not out:
        begin = int(np.searchsorted(size, size[at] - halo))
        if size[n] - size[begin] <= limit:
            cut = n
        else:
            end = int(np.searchsorted(size, size[at] + limit - 2 * halo, side="right")) - 1
            line = text.rfind("\n", at, end)
            cut = line + 1 or next((i + 1 for i in range(end - 1, at, -1) if text[i].isspace()), end)
        end = int(np.searchsorted(size, size[cut] + halo, side="right")) - 1
        out.append((begin, end, at, cut))
        at = cut
    return out


def owned(
    spans: Iterable[Span], begin: int, end: int, at: int, cut: int, size: int
) -> Iterator[Span]:
    """Spans of a window, in offsets of the text, that its owned part counts.

    Those that begin there, and the rest of one that the window before could not show
    whole: it begins where the window does and reaches into the owned part. Spans without
    offsets pass; they are no entities.
    """
    for kind, first, last in spans:
        if first is None or last is None:
            yield kind, first, last
            continue
        first, last = first + begin, last + begin
        starts_here = at <= first < cut or first >= cut == size
        if starts_here or (first == begin < at < last):
            yield kind, first, last


def replaced(
    text: str, spans: Iterable[Span], allowed: set[str], *, parity: bool = False
) -> tuple[str, int, list[str]]:
    """Text with spans of allowed kinds replaced, their number, kinds from last to first.

    What overlapping spans cover together becomes one placeholder, of the kind that begins
    first, and counts once. With ``parity`` they are spliced with their original offsets, as
    observed in the original tool, which can leave a part of them in clear. Ends beyond the
    text are cut to it; a span outside the text or with its end before its begin is none.
    """
    wanted = [s for s in spans if s[0] in allowed and s[1] is not None and s[2] is not None]
    if parity:
        wanted.sort(key=lambda s: -s[1])
        for kind, begin, end in wanted:
            text = f"{text[:begin]}[REDACTED:{kind}]{text[end:]}"
        return text, len(wanted), [s[0] for s in wanted]
    united = unite(wanted, len(text))
    return _spliced(text, united), len(united), [s[0] for s in reversed(united)]


def unite(spans: Iterable[Span], size: int) -> list[Span]:
    """Spans by begin, overlapping ones as one of the kind that begins first."""
    united: list[list] = []
    for kind, begin, end in sorted(spans, key=lambda s: s[1]):
        if not 0 <= begin <= min(end, size):
            continue
        if united and begin < united[-1][2]:
            united[-1][2] = max(united[-1][2], end)
        else:
            united.append([kind, begin, end])
    return [tuple(u) for u in united]


def _spliced(text: str, united: list[Span]) -> str:
    parts, at = [], 0
    for kind, begin, end in united:
        parts += (text[at:begin], f"[REDACTED:{kind}]")
        at = end
    return "".join([*parts, text[at:]])


def _leaves(value: Any, kind: T.DataType, take: Callable[[Any], Any]) -> Any:
    """The value with ``take`` of each text, in traversal order."""
    if isinstance(kind, T.ArrayType):
        return None if value is None else [_leaves(x, kind.elementType, take) for x in value]
    if isinstance(kind, T.StructType):
        return None if value is None else {f.name: _leaves(value[f.name], f.dataType, take) for f in kind.fields}
    return take(value)


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return pa.int32() if isinstance(kind, T.IntegerType) else pa.string()


FOUND = T.StructType(
    [T.StructField("value", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("types", T.ArrayType(T.StringType()))]
)


class BatchDetector:
    """User detector in Python.

    ``make_client`` is called once per task and returns a function from a list of texts
    to one list of ``(type, begin, end)`` per text; any other number of lists is an
    error.  Texts that fail ``hint`` never reach Python's client.  An entity longer than
    a halo is put together from what the windows show of it.
    """

    def __init__(self, make_client: Callable[[], Client], hint: str | None = None):
        self.make_client = make_client
        self.hint = hint

    def may_match(self, text: Sql) -> Sql:
        return f"{text} RLIKE {lit(self.hint)}" if self.hint else f"{text} IS NOT NULL"

    def mirrored(
        self, texts: Column, allowed: Column, kind: T.DataType, *, limit: int = CHUNK_BYTES, parity: bool = False
    ) -> Column:
        """``FOUND`` for each text of a value made by ``nested.mirror``, in its shape.

        ``kind`` is the type of the mirrored value.
        """
        make_client = self.make_client

        def detect(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[list]:
            client = make_client()
            for values, kinds in columns:
                # One row at a time: the texts of a batch have no bound together.
                yield (
                    (row, lambda flat, k=permitted: _detected(client, flat, set(k or ()), limit, parity))
                    for row, permitted in zip(values.to_pylist(), kinds.to_pylist())
                )

        return _answered(detect, kind)(texts, allowed)

    def rows(
        self, keys: Sequence[str]
    ) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """The same detector in the shape ``mapInPandas`` takes, over chunk rows."""
        make_client = self.make_client
        keys = list(keys)

        def detect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = make_client()
            columns = [*keys, "path", "chunk_idx", "ordinal", "type", "begin", "end"]
            for frame in frames:
                out: list[tuple[Any, ...]] = []
                heads = frame[[*keys, "path", "chunk_idx"]].itertuples(
                    index=False, name=None
                )
                texts, before, after = (list(frame[c]) for c in ("text", "before", "after"))
                shown = [b + t + a for b, t, a in zip(before, texts, after)]
                for head, found, t, b, a in zip(heads, answers(client, shown), texts, before, after, strict=True):
                    # The first separator behind a chunk is its own.
                    cut = len(t) + a.startswith("\n")
                    spans = owned(found, -len(b), 0, 0, cut, cut if not a else -1)
                    out.extend((*head, i, *span) for i, span in enumerate(spans))
                yield pd.DataFrame(out, columns=columns)

        return detect


def answers(client: Client, texts: Sequence[str]) -> Iterator[list[Span]]:
    """The client's spans of each text, asked in groups; too few or many are an error."""
    for at in range(0, len(texts), GROUP):
        group = texts[at : at + GROUP]
        found = [list(spans) for spans in client(group)]
        if len(found) != len(group):
            raise ValueError(f"the detector answered {len(found)} of {len(group)} texts")
        yield from found


def _detected(
    client: Client, texts: list[str | None], allowed: set[str], limit: int, parity: bool
) -> list[dict | None]:
    """``FOUND`` of each text; null texts (or texts that fail the hint) have none."""
    cuts = [(i, *w) for i, t in enumerate(texts) if t is not None for w in windows(t, limit)]
    spans: dict[int, dict[Span, None]] = {}
    pieces = [texts[i][a:b] for i, a, b, _, _ in cuts]
    for (i, *window), found in zip(cuts, answers(client, pieces), strict=True):
        for span in owned(found, *window, len(texts[i])):
            spans.setdefault(i, {})[span] = None
    out: list[dict | None] = []
    for i, text in enumerate(texts):
        if i in spans:
            out.append(dict(zip(("value", "n", "types"), replaced(text, spans[i], allowed, parity=parity))))
        else:
            out.append(None)
    return out


def _answered(answer: Callable[..., Iterator[Iterable]], kind: T.DataType) -> Callable[..., Column]:
    """Arrow UDF from mirrored texts (and more) to ``FOUND`` for each text, in their shape.

    ``answer`` yields for each batch its rows, each with a function from the row's texts in
    traversal order to what was found.
    """
    texts_kind = mirror_type(kind, T.StringType())
    found_kind = mirror_type(kind, FOUND)
    returned = arrow_type(found_kind)

    def run(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for rows in answer(columns):
            out = []
            for row, find in rows:
                flat: list[str | None] = []
                _leaves(row, texts_kind, flat.append)
                results = iter(find(flat))
                out.append(_leaves(row, texts_kind, lambda _: next(results)))
            yield pa.array(out, returned)

    # Set by hand: the module postpones its annotations.
    run.__annotations__ = {
        "columns": Iterator[tuple[pa.Array, ...]],
        "return": Iterator[pa.Array],
    }
    return F.arrow_udf(run, found_kind)


HIT = "struct<leaf:int,chunk_idx:int,ordinal:int,type:string,begin:int,end:int>"


def apply_hits(texts: Column, hits: Column, allowed: Column, kind: T.DataType) -> Column:
    """``FOUND`` for each text of a mirrored value, from a row's ``hits`` (array of ``HIT``).

    A hit names a text by its place among the row's texts that are not null, and has
    offsets in the whole text. Time follows the length of the texts and the number of hits.
    Kinds come chunk by chunk, within a chunk from the last span to the first.
    """

    def answer(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[Iterable]:
        def found(flat: list[str | None], own: list[dict] | None, kinds: list[str] | None) -> Iterator[dict | None]:
            allowed = set(kinds or ())
            of_leaf: dict[int, list[dict]] = {}
            for h in own or ():
                if h["type"] in allowed:
                    of_leaf.setdefault(h["leaf"], []).append(h)
            leaf = -1
            for text in flat:
                leaf += text is not None
                mine = of_leaf.get(leaf) if text is not None else None
                yield redacted(text, sorted(mine, key=lambda h: (h["chunk_idx"], h["ordinal"]))) if mine else None

        def redacted(text: str, mine: list[dict]) -> dict:
            united = unite([(h["type"], h["begin"], h["end"]) for h in mine], len(text))
            chunk = {h["begin"]: h["chunk_idx"] for h in reversed(mine)}
            shown = sorted(united, key=lambda u: (chunk[u[1]], -u[1]))
            return {"value": _spliced(text, united), "n": len(united), "types": [u[0] for u in shown]}

        for values, own, kinds in columns:
            yield (
                (row, lambda flat, h=h, k=k: found(flat, h, k))
                for row, h, k in zip(values.to_pylist(), own.to_pylist(), kinds.to_pylist())
            )

    return _answered(answer, kind)(texts, hits, allowed)
