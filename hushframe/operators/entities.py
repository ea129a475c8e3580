"""Entity stage over tables.

Spans come from a detector (native or user Python), or from a table the user
supplies.  With a detector everything stays in the row: no shuffle, and the same
function works on a stream.  A native detector is part of the walk over a record; one in
Python gets the record's texts in their own shape and answers in it.  With a table there
is one join on the row key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions import spans as s
from hushframe.functions import detectors as d
from hushframe.functions.chunks import chunk_text, with_halos
from hushframe.functions.detectors import BatchDetector, PatternDetector
from hushframe.functions.jsontext import any_escape, redact_json_text
from hushframe.functions.masks import NO_TYPES, may_hold_pii, redact
from hushframe.functions.nested import (
    MIRRORS,
    Leaf,
    escaped,
    mirror,
    text_leaves,
    variant_leaf,
)
from hushframe.functions.patterns import CHUNK_BYTES
from hushframe.functions.sqltext import Sql, empty, filter_, let, lit, name, struct, transform, when
from hushframe.operators.redact import (
    COUNT,
    TYPES,
    compute,
    aside,
    helper_names,
    json_column,
    redact_table,
    text_columns,
    walk_helpers,
    walk_table,
)

Detector = PatternDetector | BatchDetector
Allowed = Sequence[str] | None


# --- leaves and chunks ------------------------------------------------------


def row_leaves(df: DataFrame, columns: Sequence[str]) -> Sql:
    """All texts of a row in traversal order: array<struct<path, text>>."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [text_leaves(name(c), kinds[c], lit(escaped(c))) for c in columns]
    if not parts:
        return empty("struct<path:string,text:string>")
    return f"concat({', '.join(parts)})"


def chunk_rows(
    df: DataFrame,
    key: str | Sequence[str],
    columns: Sequence[str] | None = None,
    *,
    limit: int = CHUNK_BYTES,
    parity: bool = False,
) -> DataFrame:
    """One row per chunk: key, path, chunk_idx, text, sep, start, before, after, leaf, size.

    ``before`` and ``after`` are the ends of the text beside the chunk, for detectors;
    ``leaf`` is the place of the chunk's text among the row's texts, ``size`` its length.
    With ``parity`` chunks are looked at one by one, as the original tool did.
    """
    keys = [key] if isinstance(key, str) else list(key)
    columns = text_columns(df, columns, keys)
    # A text's size is taken before its chunks are rows: none of them then carries the text.
    leaves = df.select(*keys, F.posexplode(F.expr(row_leaves(df, columns))).alias("leaf", "_leaf")).select(
        *keys, "_leaf.path", "leaf", F.length("_leaf.text").alias("size"), F.col("_leaf.text").alias("_text")
    )

    def shown(chunks: Sql) -> Sql:
        if not parity:
            return with_halos(chunks)
        return transform(
            chunks, lambda c: struct(text=f"{c}.text", sep=f"{c}.sep", start=f"{c}.start", before="''", after="''")
        )

    return leaves.select(
        *keys,
        "path",
        "leaf",
        "size",
        F.posexplode(F.expr(let(chunk_text("_text", limit, parity=parity), shown))).alias("chunk_idx", "_chunk"),
    ).select(*keys, "path", "chunk_idx", "_chunk.*", "leaf", "size")


def detect_entities(
    chunks: DataFrame, detector: Detector, key: str | Sequence[str]
) -> DataFrame:
    """Entities of chunk rows: key, path, chunk_idx, ordinal, type, begin, end.

    A detector sees a chunk with its surroundings, up to ``HALO_BYTES`` on each side. A
    chunk owns the entities that begin in it; their offsets count from its begin, and an
    end may lie behind its end. Of an entity that reaches further than a halo the next chunk
    gives the rest, with a negative begin: both are united where they are applied.

    A Python detector runs over Arrow batches of chunks, which bounds a batch to
    its number of rows times the chunk limit.
    """
    keys = [key] if isinstance(key, str) else list(key)
    head = [*keys, "path", "chunk_idx"]
    if isinstance(detector, BatchDetector):
        kinds = {f.name: f.dataType for f in chunks.schema.fields}
        schema = T.StructType([T.StructField(c, kinds[c]) for c in head])
        for name, kind in (
            ("ordinal", T.IntegerType()),
            ("type", T.StringType()),
            ("begin", T.IntegerType()),
            ("end", T.IntegerType()),
        ):
            schema = schema.add(name, kind)
        texts = chunks.where(detector.may_match(_SHOWN))
        return texts.select(*head, "text", "before", "after").mapInPandas(detector.rows(keys), schema)
    off = "length(before)"

    def counted(spans: Sql) -> Sql:
        moved = transform(
            spans, lambda x: struct(type=f"{x}.type", begin=f"{x}.begin - {off}", end=f"{x}.`end` - {off}")
        )
        cut = "length(text) + length(sep)"
        here = lambda x: f"({x}.begin >= 0 AND ({x}.begin < {cut} OR after = ''))"
        rest = lambda x: f"({x}.begin = -{off} AND {x}.begin < 0 AND {x}.`end` > 0)"
        return filter_(moved, lambda x: f"{here(x)} OR {rest(x)}")

    found = F.expr(let(detector.spans_of(_SHOWN), counted))
    return (
        chunks.where(detector.may_match(_SHOWN))
        .select(*head, F.posexplode(found).alias("ordinal", "_span"))
        .select(*head, "ordinal", "_span.type", "_span.begin", "_span.end")
    )


# A chunk with its surroundings.
_SHOWN = "concat(before, text, after)"


def entity_filter(entities: DataFrame, types: Allowed = None) -> DataFrame:
    """Entities of an allowed kind whose offsets are known; the filter reaches the scan."""
    kinds = s.ENTITY_TYPES if types is None else types
    return entities.where(
        F.col("type").isin(list(kinds)) & F.col("begin").isNotNull() & F.col("end").isNotNull()
    )


def prefilter(texts: DataFrame, entities: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Texts in which the detector sees anything at all.

    Labels of every kind count, also those outside the allow-list.
    """
    keys = [key] if isinstance(key, str) else list(key)
    # Distinct first: a key with many entities goes through the shuffle once.
    return texts.join(entities.select(*keys).distinct(), keys, "left_semi")


def _inside(entities: DataFrame, chunks: DataFrame, on: list[str]) -> DataFrame:
    """Entities of known chunks that lie in their text, with the chunk's ``start`` and ``leaf``.

    A key that no chunk has (a sentinel, say) may hold any share of the entities and must
    not reach a grouping. Both sides of the join are plain, and what follows groups by other
    expressions than the join's keys and so has a shuffle of its own: adaptive execution is
    free to split a skewed partition of the join.
    """
    places = chunks.select(*on, "start", "leaf", F.col("size").alias("_size"))
    joined = entities.select(*on, "ordinal", "type", "begin", "end").join(places, on)
    begin, end = F.col("start") + F.col("begin"), F.col("start") + F.col("end")
    return joined.where((begin >= 0) & (begin <= end) & (end <= F.col("_size"))).drop("_size")


def entities_to_chunks(
    chunks: DataFrame, entities: DataFrame, key: str | Sequence[str]
) -> DataFrame:
    """Chunk rows with their entities as ``spans`` (empty where there are none).

    Entities of no known chunk, and those whose offsets lie outside its text, are dropped
    before they are grouped, and copies of an entity count once; what is left of a group is
    bounded by its chunk.
    """
    keys = [key] if isinstance(key, str) else list(key)
    on = [*keys, "path", "chunk_idx"]
    at = F.struct(*on).alias("_at")
    span = F.struct("ordinal", "type", "begin", "end")
    grouped = (
        _inside(entities, chunks, on).groupBy(at).agg(F.array_sort(F.collect_set(span)).alias("spans"))
        .select(*[F.col("_at")[c].alias(c) for c in on], "spans")
    )
    empty = F.array().cast(
        "array<struct<ordinal:int,type:string,begin:int,end:int>>"
    )
    return chunks.join(grouped, on, "left").withColumn(
        "spans", F.coalesce(F.col("spans"), empty)
    )


def redact_chunk_rows(
    chunks: DataFrame, types: Allowed = None, *, spans: str = "spans"
) -> DataFrame:
    """Apply the spans of each chunk row to its text; adds count and kinds.

    Overlapping spans become one placeholder. A span that reaches over the end of its chunk
    is cut there; ``redact_with_entities`` replaces it whole.
    """
    united = s.united_spans(s.relevant_spans(spans, s.allowed_types(types)), "length(text)")
    applied = when(("size(_united) > 0", s.splice_spans("text", "_united")), other="text")
    return (
        compute(chunks, _united=united)
        .withColumns(
            {
                "text": F.expr(applied),
                COUNT: F.size("_united"),
                TYPES: F.array_distinct(F.reverse("_united.type")),
            }
        )
        .drop("_united")
    )


# --- detection in the row ---------------------------------------------------


def native_leaf(detector: PatternDetector, allowed: Sql, *, limit: int = CHUNK_BYTES, parity: bool = False) -> Leaf:
    """Leaf of the walk that detects and replaces in one."""

    def stage(text: Sql) -> Sql:
        return let(
            detector.redacted(text, allowed, limit=limit, parity=parity),
            lambda r: struct(value=f"{r}.value", n=f"{r}.n", types=NO_TYPES, entity_types=f"{r}.types"),
        )

    def leaf(text: Sql, place: Sql) -> Sql:
        return stage(text)

    leaf.variant = variant_leaf(lambda text: redact_json_text(text, stage, any_escape(detector.may_match), valid=True))
    return leaf


def found_leaf(text: Sql, place: Sql) -> Sql:
    """Leaf of the walk that takes a text's result from its place in the answer."""
    return when(
        (
            f"{place} IS NOT NULL",
            struct(value=f"{place}.value", n=f"{place}.n", types=NO_TYPES, entity_types=f"{place}.types"),
        ),
        other=struct(value=text, n="0", types=NO_TYPES, entity_types=NO_TYPES),
    )


def walk_detected(
    df: DataFrame,
    columns: Sequence[str],
    detector: Detector,
    types: Allowed = None,
    *,
    limit: int = CHUNK_BYTES,
    parity: bool = False,
) -> DataFrame:
    """Entity stage over the texts of ``columns``; adds count and kinds."""
    allowed = s.allowed_types(types)
    if isinstance(detector, PatternDetector):
        leaf = native_leaf(detector, allowed, limit=limit, parity=parity)
        return _totalled(*walk_table(df, columns, leaf))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    helpers = helper_names(df, len(columns), "found")

    def asked(text: Sql) -> Sql:
        return when((detector.may_match(text), f"cast({text} AS string)"), other="cast(NULL AS string)")

    # Texts are kept as columns of a generator: a Python stage would compute them again.
    texts = compute(df, **{h: mirror(name(c), kinds[c], asked) for h, c in zip(helpers, columns)})
    found = texts.withColumns(
        {
            h: detector.mirrored(F.col(h), F.expr(allowed), kinds[c], limit=limit, parity=parity)
            for h, c in zip(helpers, columns)
        }
    )
    places = dict(zip(columns, helpers))
    values, n, first, second = walk_table(found, columns, found_leaf, places, MIRRORS)
    return _totalled(values, n, first, second).drop(*helpers)


def _totalled(values: DataFrame, n: Column, first: Column, second: Column) -> DataFrame:
    return values.withColumns({COUNT: n, TYPES: second}).drop(*walk_helpers(values))


# --- spans of a table -------------------------------------------------------


def join_hits(
    df: DataFrame,
    chunks: DataFrame,
    entities: DataFrame,
    key: str | Sequence[str],
    types: Allowed = None,
    *,
    parity: bool = False,
) -> DataFrame:
    """Add ``_hits`` from an entity table keyed by row key, path and chunk.

    ``chunks`` are the chunk rows of ``df``.  The key must identify a row of ``df``, and
    the ordinal an entity of its chunk: copies of an entity, as a repeated detector run
    writes them, count once.  Null keys never match.  Entities of no known chunk, and those
    whose offsets lie outside its text, are dropped before anything is grouped; what is
    left of a group is bounded by the texts of its row. Offsets in ``_hits`` are those of
    the text; with ``parity`` those of the chunk, which its spans must not leave.
    """
    keys = [key] if isinstance(key, str) else list(key)
    on = [*keys, "path", "chunk_idx"]
    wanted = entity_filter(entities, types)  # reaches the scan of the table
    for k in keys:
        wanted = wanted.where(F.col(k).isNotNull())
    first = F.lit(0) if parity else F.col("start")
    if parity:
        chunks = chunks.withColumns({"start": F.lit(0), "size": F.length("text")})
    hit = {
        **({"path": F.col("path")} if parity else {"leaf": F.col("leaf").cast("int")}),
        **{c: F.col(c).cast("int") for c in ("chunk_idx", "ordinal")},
        "type": F.col("type"),
        **{c: (F.col(c) + first).cast("int") for c in ("begin", "end")},
    }
    spans = _inside(wanted, chunks, on).select(*keys, F.struct(*[v.alias(c) for c, v in hit.items()]).alias("_hit"))
    grouped = spans.groupBy(*keys).agg(F.collect_set("_hit").alias("_hits"))
    nothing = s.NO_HITS if parity else empty(d.HIT)
    return df.join(grouped, keys, "left").withColumn("_hits", F.expr(f"coalesce(_hits, {nothing})"))


def apply_hits(
    df: DataFrame,
    columns: Sequence[str],
    types: Allowed = None,
    *,
    limit: int = CHUNK_BYTES,
    parity: bool = False,
) -> DataFrame:
    """Apply ``_hits`` to the texts of ``columns``; adds count and kinds.

    ``columns`` are those of the chunk rows, in the same order. Texts of rows without hits
    do not leave the JVM.
    """
    allowed = s.allowed_types(types)
    if parity:
        leaf = s.hits_leaf("_hits", allowed, limit=limit, parity=True)
        return _totalled(*walk_table(df, columns, leaf)).drop("_hits")
    if not columns:
        return df.withColumns({COUNT: F.lit(0), TYPES: F.expr(NO_TYPES)}).drop("_hits")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    record, *helpers = helper_names(df, 1 + len(columns), "found")
    fields = [f"c{i}" for i in range(len(columns))]
    kind = T.StructType([T.StructField(f, kinds[c]) for f, c in zip(fields, columns)])
    parts = ", ".join(
        f"{mirror(name(c), kinds[c], lambda text: f'cast({text} AS string)')} AS {f}" for f, c in zip(fields, columns)
    )
    # Texts are kept as a column of a generator: a Python stage would compute them again.
    asked = compute(df, **{record: when(("size(_hits) > 0", f"struct({parts})"))})
    found = asked.withColumn(record, d.apply_hits(F.col(record), F.col("_hits"), F.expr(allowed), kind))
    found = found.withColumns({h: F.col(record)[f] for h, f in zip(helpers, fields)})
    values, n, first, second = walk_table(found, columns, found_leaf, dict(zip(columns, helpers)), MIRRORS)
    return _totalled(values, n, first, second).drop(record, *helpers, "_hits")


# --- whole operators --------------------------------------------------------


def redact_entities(
    df: DataFrame,
    detector: Detector,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    types: Allowed = None,
    *,
    limit: int = CHUNK_BYTES,
    parity: bool = False,
) -> DataFrame:
    """Entity stage alone over all texts of a record, in the row."""
    df, columns = aside(df, text_columns(df, include, exclude))
    return walk_detected(df, columns, detector, types, limit=limit, parity=parity)


def redact_with_entities(
    df: DataFrame,
    entities: DataFrame,
    key: str | Sequence[str],
    include: Sequence[str] | None = None,
    types: Allowed = None,
    *,
    limit: int = CHUNK_BYTES,
    parity: bool = False,
) -> DataFrame:
    """Entity stage alone, with spans from a table."""
    keys = [key] if isinstance(key, str) else list(key)
    df, columns = aside(df, text_columns(df, include, keys))
    chunks = chunk_rows(df, keys, columns, limit=limit, parity=parity)
    found = join_hits(df, chunks, entities, keys, types, parity=parity)
    return apply_hits(found, columns, types, limit=limit, parity=parity)


def redact_deep(
    df: DataFrame,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    *,
    detector: Detector | None = None,
    entities: DataFrame | None = None,
    key: str | Sequence[str] | None = None,
    types: Allowed = None,
    limit: int = CHUNK_BYTES,
    parity: bool = False,
) -> DataFrame:
    """Pattern stage, then entity stage on its output, with merged totals.

    Without a detector or an entity table only the pattern stage runs.  Offsets
    in ``entities`` refer to the chunks of the pattern stage's output.
    """
    keys = [] if key is None else [key] if isinstance(key, str) else list(key)
    columns = text_columns(df, include, [*exclude, *(keys if entities is not None else [])])
    if detector is None and entities is None:
        return redact_table(df, columns)
    # A key is joined raw and masked afterwards, if it is named or may hold text.
    masked_keys = [k for k in keys if k in text_columns(df, include, exclude)]
    options = {"limit": limit, "parity": parity}
    if entities is not None and not keys:
        raise ValueError("an entity table needs the key of the rows")
    df, columns = aside(df, columns)
    first = redact_table(df, columns)
    n1, types1 = helper_names(first, 2, "first")
    first = first.withColumnsRenamed({COUNT: n1, TYPES: types1})
    if entities is None:
        done = walk_detected(first, columns, detector, types, **options)
    else:
        chunks = chunk_rows(first, keys, columns, **options)
        done = apply_hits(join_hits(first, chunks, entities, keys, types, parity=parity), columns, types, **options)
    if entities is not None and masked_keys:
        done = redact_keys(done, masked_keys, n1, types1)
    return done.withColumns(
        {
            COUNT: F.col(n1) + F.col(COUNT),
            TYPES: F.array_distinct(F.concat(types1, TYPES)),
        }
    ).drop(n1, types1)


def redact_keys(df: DataFrame, keys: Sequence[str], n: str, types: str) -> DataFrame:
    """Pattern stage on key columns, after the join on their raw values.

    Its totals go to ``n`` and ``types``; those of the entity stage stay as they are.
    """
    count, found = helper_names(df, 2, "entity")
    done = redact_table(df.withColumnsRenamed({COUNT: count, TYPES: found}), keys)
    totals = {n: F.col(n) + F.col(COUNT), types: F.array_distinct(F.concat(TYPES, types))}
    return done.withColumns(totals).drop(COUNT, TYPES).withColumnsRenamed({count: COUNT, found: TYPES})


def redact_json_deep(
    df: DataFrame, column: str, *, detector: PatternDetector, types: Allowed = None
) -> DataFrame:
    """Both stages on a column of JSON text of unknown schema: values only.

    Each string value goes through the pattern stage and the detector on its output; no
    pass over the data infers a schema.  The detector is a native one; for one in Python
    parse the column to a type and use ``redact_deep``.
    """
    if not isinstance(detector, PatternDetector):
        raise ValueError("JSON of unknown schema needs a native detector")
    allowed = s.allowed_types(types)

    def stage(text: Sql) -> Sql:
        return let(
            redact(text),
            lambda a: let(
                detector.redacted(f"{a}.value", allowed),
                lambda b: struct(
                    value=f"{b}.value", n=f"{a}.n + {b}.n", types=f"{a}.types", entity_types=f"{b}.types"
                ),
            ),
        )

    def hint(text: Sql) -> Sql:
        return f"({may_hold_pii(text)} OR {detector.may_match(text)})"

    return json_column(df, column, redact_json_text(name(column), stage, any_escape(hint)))
