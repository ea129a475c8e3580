"""One query per operator: ``(spark, sf_dir) -> DataFrame``.

Each runs over whole tables and returns flat columns, so that results can be
compared with SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as v
from hushframe.functions import chunks as chunking
from hushframe.functions import masks, spans
from hushframe.functions.detectors import (
    AnyDetector,
    BatchDetector,
    PatternDetector,
    ip_detector,
)
from hushframe.functions.patterns import LEFT, RIGHT
from hushframe.operators import audit, calls, entities, merge, profiles, redact, reports
from hushframe.plans.chain import answer, compose, failures_to_results
from hushframe.sources import tables
from hushframe.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def kinds(column: str = redact.TYPES) -> Column:
    """A kind list as text."""
    return F.array_join(column, ",").alias("redacted_types")


def count(column: str = redact.COUNT) -> Column:
    return F.col(column).cast("long").alias("redaction_count")


# --- sources and sinks ------------------------------------------------------


@query
def scan_text(spark, sf_dir):
    return v.texts(spark, sf_dir)


@query
def call_blocks(spark, sf_dir):
    blocks = calls.explode_blocks(v.calls(spark, sf_dir), "call_id")
    return blocks.select(
        "call_id",
        F.coalesce(F.col("block_idx"), F.lit(-1)).cast("long").alias("block_idx"),
        "type",
        "text",
        "data",
        F.col("mimeType").alias("mime_type"),
    )


@query
def resource_items(spark, sf_dir):
    items = calls.explode_items(v.resources(spark, sf_dir), "page_id")
    return items.select(
        "page_id",
        F.col("item_idx").cast("long").alias("item_idx"),
        "item_uri",
        F.col("mimeType").alias("mime_type"),
        "text",
        "blob",
    )


@query
def audit_jsonl(spark, sf_dir):
    path = tables.workspace(spark, "audit")
    records = audit.audit_log(calls.redact_calls(v.calls(spark, sf_dir)))
    tables.write_audit(records, tables.jsonl_writer(path))
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def redacted_sink(spark, sf_dir):
    path = tables.workspace(spark, "redacted")
    tables.write_redacted(
        redact.redact_text(v.documents(spark, sf_dir), "text"),
        path,
        partition_by=["lang"],
    )
    back = spark.read.parquet(path)
    return back.select("doc_id", "lang", "source", "n_chars", "text", count(), kinds())


# --- gates ------------------------------------------------------------------


def _call_bodies(df: DataFrame) -> DataFrame:
    """A call's blocks as one text, to compare."""
    body = F.array_join(
        F.transform(
            "content",
            lambda b: F.concat_ws(":", b["type"], F.coalesce(b["text"], b["data"])),
        ),
        "\n",
    )
    return df.select(
        "call_id",
        F.coalesce(F.size("content"), F.lit(-1)).cast("long").alias("n_blocks"),
        body.alias("body"),
        "is_error",
        count(),
        kinds(),
    )


@query
def text_blocks_only(spark, sf_dir):
    done = calls.redact_calls(v.calls(spark, sf_dir), profile="full")
    return calls.explode_blocks(done, "call_id").select(
        "call_id",
        F.coalesce(F.col("block_idx"), F.lit(-1)).cast("long").alias("block_idx"),
        "type",
        "text",
        "data",
    )


@query
def error_passthrough(spark, sf_dir):
    return _call_bodies(calls.redact_calls(v.calls(spark, sf_dir), profile="full"))


@query
def legacy_passthrough(spark, sf_dir):
    done = calls.redact_calls(v.calls(spark, sf_dir), profile="DORA")
    return done.select(
        "call_id",
        F.col("content").isNull().alias("legacy"),
        F.coalesce(F.size("content"), F.lit(-1)).cast("long").alias("n_blocks"),
        count(),
        kinds(),
    )


@query
def blob_passthrough(spark, sf_dir):
    done = calls.redact_resources(v.resources(spark, sf_dir), profile="PCI_DSS")
    return calls.explode_items(done, "page_id").select(
        "page_id", F.col("item_idx").cast("long").alias("item_idx"), "text", "blob"
    )


@query
def stage_gate(spark, sf_dir):
    """Stages off and on, row by row; the pattern stage off switches off both."""
    names = F.array(*[F.lit(p.name) for p in v.GATED])
    docs = v.documents(spark, sf_dir).withColumn(
        "profile",
        F.element_at(names, (F.col("doc_id") % len(v.GATED) + 1).cast("int")),
    )
    done = calls.redact_by_profile(
        docs, "text", profiles=v.GATED, detector=ip_detector()
    )
    return done.select("doc_id", "profile", "text", count(), kinds())


@query
def entity_filter(spark, sf_dir):
    found = _document_entities(spark, sf_dir)
    return entities.entity_filter(found, ["IP_ADDRESS", "NAME"]).select(
        "doc_id", *_entity_columns()
    )


@query
def luhn_valid(spark, sf_dir):
    found = v.texts(spark, sf_dir).select(
        "text_id", F.posexplode(F.expr(masks.card_matches("text"))).alias("ordinal", "m")
    )
    return found.select(
        "text_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        F.expr(masks.card_digits("m")).alias("digits"),
        F.expr(masks.luhn_valid("m")).alias("valid"),
    )


@query
def iban_min_len(spark, sf_dir):
    c = v.customers(spark, sf_dir)
    code = F.left(
        F.concat(F.col("iban"), F.lit("ABCDEFGH12345678")),
        (F.col("c_custkey") % 27 + 8).cast("int"),
    )
    text = c.select("c_custkey", F.concat(F.lit("to "), code).alias("text"))
    done = redact.mask_text(text, "text", "iban")
    return done.select("c_custkey", "text", count())


@query
def audit_enabled(spark, sf_dir):
    records = audit.audit_log(calls.redact_calls(v.calls(spark, sf_dir)))
    parts = []
    for enabled in (True, False):
        path = tables.workspace(spark, "audit")
        spark.createDataFrame([], "line string").write.text(path)
        tables.write_audit(records, tables.jsonl_writer(path), enabled=enabled)
        lines = spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"))
        parts.append(lines.select(F.lit(enabled).alias("enabled"), "n_lines"))
    return parts[0].union(parts[1])


# --- look-ups ---------------------------------------------------------------


@query
def profile_lookup(spark, sf_dir):
    found = profiles.with_profile(v.calls(spark, sf_dir))
    return found.select(
        "call_id",
        "profile",
        "profile_name",
        "stage1",
        "stage2",
        F.array_join("entity_types", ",").alias("entity_types"),
        "profile_fallback",
    )


@query
def audit_stats_attach(spark, sf_dir):
    stats = _merged_blocks(spark, sf_dir)
    joined = audit.attach_stats(v.calls(spark, sf_dir), stats)
    return joined.select("call_id", "tool_name", count(), kinds())


@query
def entities_to_chunks(spark, sf_dir):
    chunks = entities.chunk_rows(v.documents(spark, sf_dir), "doc_id", ["text"])
    found = entities.detect_entities(chunks, v.RULES, "doc_id")
    joined = entities.entities_to_chunks(chunks, found, "doc_id")
    shown = F.transform(
        "spans",
        lambda s: F.concat_ws(
            ":", s["ordinal"].cast("string"), s["type"],
            s["begin"].cast("string"), s["end"].cast("string"),
        ),
    )
    return joined.select(
        "doc_id",
        F.col("chunk_idx").cast("long").alias("chunk_idx"),
        F.array_join(shown, ",").alias("spans"),
    )


# --- counts and kinds -------------------------------------------------------


def _redacted_texts(spark, sf_dir, **options):
    return redact.redact_text(v.texts(spark, sf_dir), "text", **options)


@query
def redaction_count(spark, sf_dir):
    return _redacted_texts(spark, sf_dir).select("text_id", count())


@query
def redacted_types(spark, sf_dir):
    return _redacted_texts(spark, sf_dir).select("text_id", kinds())


@query
def record_totals(spark, sf_dir):
    done = redact.redact_table(v.records(spark, sf_dir))
    return done.select("c_custkey", count(), kinds())


def _merged_blocks(spark, sf_dir):
    """Totals per call from exploded blocks of calls that are not errors."""
    source = v.calls(spark, sf_dir)
    blocks = source.where(~F.col("is_error")).select(
        "call_id", F.posexplode("content").alias("block_idx", "block")
    )
    texts = blocks.where(F.col("block.type") == "text").select(
        "call_id", "block_idx", F.col("block.text").alias("text")
    )
    done = redact.redact_text(texts, "text")
    return merge.merge_groups(done, ["call_id"], "block_idx")


@query
def merge_blocks(spark, sf_dir):
    return _merged_blocks(spark, sf_dir).select("call_id", count(), kinds())


@query
def merge_stages(spark, sf_dir):
    first = redact.redact_text(v.documents(spark, sf_dir), "text").select(
        "doc_id",
        "text",
        F.col(redact.COUNT).alias("n1"),
        F.col(redact.TYPES).alias("t1"),
    )
    second = entities.redact_entities(first, v.RULES, ["text"])
    n, types = merge.merge_stages(
        F.col("n1"), F.col("t1"), F.col(redact.COUNT), F.col(redact.TYPES)
    )
    return second.select(
        "doc_id",
        n.cast("long").alias("redaction_count"),
        F.array_join(types, ",").alias("redacted_types"),
    )


@query
def merge_custom_kinds(spark, sf_dir):
    """Kinds of a user's detector that no list names, merged over the chunks."""
    chunks = entities.chunk_rows(v.documents(spark, sf_dir), "doc_id", ["text"])
    marks = PatternDetector("SHOUT", LEFT + "[A-Z]{6,12}" + RIGHT), PatternDetector("DIGITS", r"[0-9]{3,}")
    found = chunks.withColumn("spans", F.expr(AnyDetector(*marks).spans_of("text")))
    done = entities.redact_chunk_rows(found, ["SHOUT", "DIGITS"])
    return merge.merge_groups(done, ["doc_id"], "chunk_idx").select("doc_id", count(), kinds())


@query
def merge_chunks(spark, sf_dir):
    done = _redacted_chunks(spark, sf_dir)
    merged = merge.merge_groups(done, ["doc_id"], "chunk_idx")
    return merged.select("doc_id", count(), kinds())


# --- order and truncation ---------------------------------------------------


@query
def spans_desc(spark, sf_dir):
    chunks = entities.chunk_rows(v.documents(spark, sf_dir), "doc_id", ["text"])
    ordered = F.expr(spans.spans_desc(v.RULES.spans_of("text")))
    return chunks.select(
        "doc_id",
        F.col("chunk_idx").cast("long").alias("chunk_idx"),
        F.posexplode(ordered).alias("place", "s"),
    ).select(
        "doc_id",
        "chunk_idx",
        F.col("place").cast("long").alias("place"),
        "s.type",
        F.col("s.begin").cast("long").alias("begin"),
        F.col("s.end").cast("long").alias("end"),
    )


@query
def truncate_input(spark, sf_dir):
    return v.texts(spark, sf_dir).select(
        "text_id", audit.truncate_input(F.col("text")).alias("input_parameters")
    )


# --- masks ------------------------------------------------------------------


def _mask_query(kind: str) -> Query:
    def run(spark, sf_dir):
        done = redact.mask_text(v.texts(spark, sf_dir), "text", kind)
        return done.select("text_id", "text", count())

    return run


for _kind in masks.MASKS:
    QUERIES[f"mask_{_kind}"] = _mask_query(_kind)


@query
def redact_text(spark, sf_dir):
    done = _redacted_texts(spark, sf_dir, by_kind=True)
    per_kind = [F.col(f"n_{k}").cast("long").alias(f"n_{k}") for k in masks.MASKS]
    return done.select("text_id", "text", count(), kinds(), *per_kind)


# --- nested values ----------------------------------------------------------


@query
def redact_struct(spark, sf_dir):
    done = redact.redact_table(v.records(spark, sf_dir).select("c_custkey", "user"))
    return done.select(
        "c_custkey",
        F.col("user.id").alias("id"),
        F.col("user.contact.email").alias("email"),
        F.col("user.contact.ssn").alias("ssn"),
        count(),
        kinds(),
    )


@query
def redact_array(spark, sf_dir):
    done = redact.redact_table(v.records(spark, sf_dir).select("c_custkey", "emails"))
    return done.select(
        "c_custkey",
        F.size("emails").cast("long").alias("n_emails"),
        F.array_join("emails", "|", "null").alias("emails"),
        count(),
        kinds(),
    )


@query
def redact_map(spark, sf_dir):
    done = redact.redact_table(v.records(spark, sf_dir).select("c_custkey", "attrs"))
    return done.select(
        "c_custkey",
        F.array_join(F.map_keys("attrs"), "|").alias("attr_names"),
        F.array_join(F.map_values("attrs"), "|").alias("attr_values"),
        count(),
        kinds(),
    )


@query
def primitive_passthrough(spark, sf_dir):
    events = v.table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        "props",
        (F.col("value") > 10).alias("active"),
        F.lit(4111111111111111).alias("card_number"),
        F.lit(None).cast("string").alias("nothing"),
    )
    done = redact.redact_table(events)
    return done.select(*events.columns, count(), kinds())


@query
def redact_table(spark, sf_dir):
    done = redact.redact_table(v.records(spark, sf_dir))
    return done.select(
        "c_custkey",
        "balance",
        "active",
        F.col("user.contact.email").alias("email"),
        F.col("user.contact.ssn").alias("ssn"),
        F.array_join("emails", "|", "null").alias("emails"),
        F.array_join(F.map_keys("attrs"), "|").alias("attr_names"),
        F.array_join(F.map_values("attrs"), "|").alias("attr_values"),
        F.array_join(F.col("payments.card"), "|", "null").alias("cards"),
        F.array_join(F.col("payments.note"), "|").alias("notes"),
        F.col("payments")[0]["amount"].alias("amount"),
        "nothing",
        count(),
        kinds(),
    )


@query
def redact_json(spark, sf_dir):
    done = redact.redact_json(v.json_documents(spark, sf_dir), "doc")
    return done.select("doc_id", "doc", count(), kinds())


# --- entity stage -----------------------------------------------------------


def _entity_columns() -> list[Column]:
    return [
        F.col("chunk_idx").cast("long").alias("chunk_idx"),
        F.col("ordinal").cast("long").alias("ordinal"),
        F.col("type"),
        F.col("begin").cast("long").alias("begin"),
        F.col("end").cast("long").alias("end"),
    ]


def _document_entities(spark, sf_dir):
    chunks = entities.chunk_rows(v.documents(spark, sf_dir), "doc_id", ["text"])
    return entities.detect_entities(chunks, v.RULES, "doc_id")


def _redacted_chunks(spark, sf_dir):
    """Chunk rows of all documents with their spans applied, without a join."""
    chunks = entities.chunk_rows(v.documents(spark, sf_dir), "doc_id", ["text"])
    found = chunks.withColumn("spans", F.expr(v.RULES.spans_of("text")))
    return entities.redact_chunk_rows(found)


@query
def redact_json_deep(spark, sf_dir):
    """Both stages on JSON of unknown schema; a document's text as a value beside a key."""
    docs = v.documents(spark, sf_dir).select(
        "doc_id",
        F.concat(
            F.lit('{"page": {"x@y.zz": 1, "body": '), F.to_json(F.array("text")),
            F.lit(', "n": '), F.col("n_chars").cast("string"), F.lit("}, "),
            F.lit('"source": '), F.to_json(F.array("source")), F.lit("}"),
        ).alias("doc"),
    )
    done = entities.redact_json_deep(docs, "doc", detector=v.RULES)
    page = F.from_json("doc", "page struct<body: array<string>, n: bigint>")["page"]
    return done.select(
        "doc_id", page["body"][0].alias("text"), page["n"].alias("n"),
        F.col("doc").startswith('{"page": {"x@y.zz": 1, "body": ').alias("key_kept"), count(), kinds(),
    )


@query
def redact_variant(spark, sf_dir):
    """VARIANT columns, at the top and in a struct, in both stages."""
    docs = v.documents(spark, sf_dir).select(
        "doc_id",
        F.parse_json(F.to_json(F.struct("text", "n_chars"))).alias("page"),
        F.struct(F.parse_json(F.to_json(F.struct("source"))).alias("v"), F.col("lang")).alias("tags"),
    )
    done = entities.redact_deep(docs, exclude=["doc_id"], detector=v.RULES)
    return done.select(
        "doc_id",
        F.variant_get("page", "$.text", "string").alias("text"),
        F.variant_get("page", "$.n_chars", "bigint").alias("n_chars"),
        F.variant_get("tags.v", "$.source", "string").alias("source"),
        F.col("tags.lang").alias("lang"), count(), kinds(),
    )


@query
def redact_deep_long_lines(spark, sf_dir):
    """Both stages over whole texts whose lines are longer than a chunk."""
    pages = v.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages:"), F.col("page_id").cast("string")).alias("text_id"), F.col("html").alias("text")
    )
    docs = v.documents(spark, sf_dir).select(
        F.concat(F.lit("documents:"), F.col("doc_id").cast("string")).alias("text_id"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"),
    )
    done = entities.redact_deep(pages.union(docs), ["text"], detector=v.RULES)
    return done.select("text_id", "text", count(), kinds())


@query
def prefilter_contains(spark, sf_dir):
    docs = v.documents(spark, sf_dir)
    chunks = entities.chunk_rows(docs, "doc_id", ["text"])
    found = entities.detect_entities(chunks, ip_detector(), "doc_id")
    return entities.prefilter(docs, found, "doc_id").select("doc_id", "source")


@query
def chunk_text(spark, sf_dir):
    chunks = entities.chunk_rows(v.documents(spark, sf_dir), "doc_id", ["text"])
    return chunks.select(
        "doc_id",
        F.col("chunk_idx").cast("long").alias("chunk_idx"),
        "text",
        "sep",
        F.col("start").cast("long").alias("start"),
    )


@query
def chunk_text_parity(spark, sf_dir):
    """Observed: blank lines vanish at the start of a chunk, and some lines stay whole."""
    chunks = entities.chunk_rows(v.documents(spark, sf_dir), "doc_id", ["text"], parity=True)
    return chunks.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "text", "sep")


@query
def detect_entities(spark, sf_dir):
    return _document_entities(spark, sf_dir).select("doc_id", *_entity_columns())


@query
def detect_entities_long_lines(spark, sf_dir):
    """Entities of texts whose lines are longer than a chunk, by their place in the text."""
    one_line = F.replace("text", F.lit("\n"), F.lit(" "))
    texts = v.documents(spark, sf_dir).select(
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("spaces:"), F.col("doc_id").cast("string")).alias("text_id"), one_line.alias("text")),
                F.struct(
                    F.concat(F.lit("none:"), F.col("doc_id").cast("string")).alias("text_id"),
                    F.replace(one_line, F.lit(" "), F.lit("-")).alias("text"),
                ),
            )
        ).alias("t")
    ).select("t.*")
    chunks = entities.chunk_rows(texts, "text_id", ["text"])
    found = entities.detect_entities(chunks, v.RULES, "text_id")
    placed = found.join(chunks.select("text_id", "chunk_idx", "start"), ["text_id", "chunk_idx"])
    return placed.select(
        "text_id", "type", *[(F.col("start") + F.col(c)).cast("long").alias(c) for c in ("begin", "end")]
    )


@query
def redact_deep_narrow_kinds(spark, sf_dir):
    """One kind of three is allowed; the others hide none of it, though they overlap."""
    overlapping = AnyDetector(PatternDetector("DATE_TIME", LEFT + r"[0-9]{1,3}\.[0-9]{1,3}"), v.RULES)
    docs = v.documents(spark, sf_dir).select("doc_id", "text")
    done = entities.redact_deep(docs, ["text"], detector=overlapping, types=["IP_ADDRESS"])
    return done.select("doc_id", "text", count(), kinds())


@query
def apply_spans_overlap(spark, sf_dir):
    """Overlapping spans of a chunk become one placeholder; nothing of any span survives."""
    pairs = AnyDetector(
        PatternDetector("NAME", LEFT + "[A-Z][a-z]+ [a-z]+" + RIGHT), PatternDetector("ADDRESS", "[a-z]+ [a-z]+[.]")
    )
    chunks = entities.chunk_rows(v.documents(spark, sf_dir), "doc_id", ["text"])
    found = chunks.withColumn("spans", F.expr(pairs.spans_of("text")))
    return entities.redact_chunk_rows(found).select(
        "doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "text", count()
    )


@query
def apply_spans(spark, sf_dir):
    return _redacted_chunks(spark, sf_dir).select(
        "doc_id",
        F.col("chunk_idx").cast("long").alias("chunk_idx"),
        "text",
        count(),
        kinds(),
    )


@query
def reassemble(spark, sf_dir):
    """Chunks of every text put together again, in the row."""
    return v.texts(spark, sf_dir).select(
        "text_id",
        F.expr(chunking.reassemble(chunking.chunk_text("text"))).alias("text"),
    )


@query
def redact_entities_text(spark, sf_dir):
    docs = v.documents(spark, sf_dir).select("doc_id", "text")
    done = entities.redact_entities(docs, v.RULES, ["text"])
    return done.select("doc_id", "text", count(), kinds())


@query
def redact_entities_table(spark, sf_dir):
    done = entities.redact_entities(v.leaf_documents(spark, sf_dir), v.RULES)
    return done.select(
        "doc_id",
        F.col("page.body").alias("body"),
        F.col("page.lang").alias("lang"),
        F.array_join("lines", "\n").alias("lines"),
        F.col("tags")["source"].alias("source"),
        count(),
        kinds(),
    )


@query
def redact_deep(spark, sf_dir):
    docs = v.documents(spark, sf_dir).select("doc_id", "text")
    done = entities.redact_deep(docs, ["text"], detector=v.RULES)
    return done.select("doc_id", "text", count(), kinds())


@query
def redact_deep_joined(spark, sf_dir):
    """The same with the spans in a table, as an external model would give them."""
    docs = v.documents(spark, sf_dir).select("doc_id", "text")
    first = redact.redact_text(docs, "text").select("doc_id", "text")
    chunks = entities.chunk_rows(first, "doc_id", ["text"])
    found = entities.detect_entities(chunks, v.RULES, "doc_id")
    done = entities.redact_deep(docs, ["text"], entities=found, key="doc_id")
    return done.select("doc_id", "text", count(), kinds())


# --- calls, resources, profiles, audit --------------------------------------


@query
def redact_calls(spark, sf_dir):
    done = calls.redact_calls(v.calls(spark, sf_dir), detector=v.RULES)
    return _call_bodies(done)


@query
def redact_calls_joined(spark, sf_dir):
    """Spans from a table made by a detector over the chunks of the redacted calls."""
    source = v.calls(spark, sf_dir)
    shown = calls.redact_calls(source, profile="full").where("NOT is_error").select(
        "call_id",
        F.transform(
            "content", lambda b: F.struct(F.when(b["type"] == "text", b["text"]).alias("text"))
        ).alias("content"),
    )
    chunks = entities.chunk_rows(shown, "call_id", ["content"])
    found = entities.detect_entities(chunks, v.RULES, "call_id")
    return _call_bodies(calls.redact_calls(source, entities=found, key="call_id"))


@query
def redact_resources(spark, sf_dir):
    done = calls.redact_resources(v.resources(spark, sf_dir), detector=v.RULES)
    return calls.explode_items(done, "page_id").select(
        "page_id",
        F.col("item_idx").cast("long").alias("item_idx"),
        F.col("mimeType").alias("mime_type"),
        "text",
        "blob",
    )


@query
def profile_calls(spark, sf_dir):
    """The profiles and how many calls run under each."""
    used = profiles.with_profile(v.calls(spark, sf_dir))
    per_profile = used.groupBy("profile_name").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum(F.col("profile_fallback").cast("long")).alias("n_fallback"),
    )
    known = profiles.profile_table(spark)
    joined = known.join(per_profile, known["name"] == per_profile["profile_name"], "left")
    return joined.select(
        "name",
        "stage1",
        "stage2",
        F.array_join("entity_types", ",").alias("entity_types"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_fallback", F.lit(0)).alias("n_fallback"),
    )


QUERIES["profiles"] = QUERIES.pop("profile_calls")


def _by_profile(spark, sf_dir, **options):
    docs = v.documents(spark, sf_dir)
    names = F.array(*[F.lit(p) for p in ("GDPR", "DORA", "PCI_DSS", "full", "UNKNOWN")])
    rows = docs.withColumn(
        "profile", F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int"))
    )
    done = calls.redact_by_profile(rows, "text", detector=v.RULES, **options)
    return done.select("doc_id", "profile_name", "text", count(), kinds())


@query
def redact_by_profile(spark, sf_dir):
    return _by_profile(spark, sf_dir)


@query
def redact_by_profile_parity(spark, sf_dir):
    """Observed: every profile replaces all kinds, and texts are joined from chunks."""
    return _by_profile(spark, sf_dir, parity=True)


def _audited(spark, sf_dir):
    return audit.audit_log(
        calls.redact_calls(v.calls(spark, sf_dir)), keep=("call_id",)
    )


def _audit_row(*names: str) -> list[Column]:
    shown = {
        "redacted_types": kinds(),
        "redaction_count": count(),
    }
    return [shown.get(n, F.col(n)) for n in names]


@query
def audit_base(spark, sf_dir):
    return _audited(spark, sf_dir).select(
        "call_id",
        "timestamp",
        "upstream_tool",
        "compliance_profile",
        "input_parameters",
        "execution_time_ms",
    )


@query
def audit_success(spark, sf_dir):
    return _audited(spark, sf_dir).select(
        *_audit_row(
            "call_id", "output_size_bytes", "redaction_count", "redacted_types", "status"
        )
    )


@query
def audit_failed(spark, sf_dir):
    return _audited(spark, sf_dir).select(
        "call_id",
        "status",
        F.col("error_message").isNotNull().alias("failed"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
    )


@query
def audit_log(spark, sf_dir):
    return _audited(spark, sf_dir).select(
        *_audit_row("call_id", *audit.AUDIT_COLUMNS)
    )


@query
def audit_log_parity(spark, sf_dir):
    """Observed: parameters and failure messages are logged as they are."""
    done = calls.redact_calls(v.calls(spark, sf_dir))
    records = audit.audit_log(done, parity=True, keep=("call_id",))
    return records.select(*_audit_row("call_id", *audit.AUDIT_COLUMNS))


# --- streams ----------------------------------------------------------------


def _document_stream(spark, sf_dir):
    # The table is one file or a folder of files.
    path = f"{sf_dir.rstrip('/')}/documents.parquet*"
    return tables.stream_table(spark, path, v.SCHEMAS["documents"])


def _drain(spark: SparkSession, df: DataFrame, fmt: str = "parquet") -> str:
    """Run a stream over what is there; returns the folder of its output."""
    path = tables.workspace(spark, "stream")
    stream = streams.start(df, f"{path}/out", f"{path}/checkpoint", fmt=fmt)
    stream.awaitTermination()
    return f"{path}/out"


@query
def stream_redact(spark, sf_dir):
    stream = streams.stream_redact(_document_stream(spark, sf_dir), ["text"])
    back = spark.read.parquet(_drain(spark, stream))
    return back.select("doc_id", "text", count(), kinds())


@query
def stream_audit(spark, sf_dir):
    stream = streams.stream_audit(v.as_calls(_document_stream(spark, sf_dir)))
    lines = audit.audit_lines(stream)
    back = spark.read.text(_drain(spark, lines, "text"))
    return back.select(F.col("value").alias("line"))


@query
def stream_audit_once(spark, sf_dir):
    """Audit records by a writer that is handed each batch twice, as after a failure."""
    lines = audit.audit_lines(streams.stream_audit(v.as_calls(_document_stream(spark, sf_dir))))
    path = tables.workspace(spark, "stream")
    write = tables.once_writer(f"{path}/out")

    def again(batch: DataFrame, stream: str, number: int) -> None:
        for _ in range(2):
            write(batch, stream, number)

    streams.start_batches(lines, again, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("line")


@query
def stream_redact_deep(spark, sf_dir):
    stream = streams.stream_redact_deep(
        _document_stream(spark, sf_dir).select("doc_id", "text"), v.RULES, ["text"]
    )
    back = spark.read.parquet(_drain(spark, stream))
    return back.select("doc_id", "text", count(), kinds())


# --- user extensions --------------------------------------------------------


@query
def middleware_chain(spark, sf_dir):
    """User steps around the built-in ones; the first is closest to the data."""

    def change_input(df: DataFrame) -> DataFrame:
        via = F.concat(F.col("arguments"), F.lit(" via gate@example.com"))
        return df.withColumn("arguments", via)

    def change_output(df: DataFrame) -> DataFrame:
        return df.withColumn("status", F.upper("status"))

    def cached(df: DataFrame) -> DataFrame:
        """The answer of a cache: no later step sees these calls."""
        return df.select(
            "call_id",
            F.lit("cached").alias("input_parameters"),
            F.lit(0).alias("redaction_count"),
            F.lit("cached").alias("status"),
        )

    chain = compose(
        change_input,
        answer(
            F.col("call_id") % 19 == 0,
            cached,
            failures_to_results,
            calls.redact_calls,
            lambda df: audit.audit_log(df, keep=("call_id",)),
        ),
        change_output,
    )
    return chain(v.calls(spark, sf_dir)).select(
        *_audit_row("call_id", "input_parameters", "redaction_count", "status"),
        F.coalesce("output_size_bytes", F.lit(-1)).alias("output_size_bytes"),
        F.col("error_message").isNotNull().alias("failed"),
    )


def python_ip_detector() -> BatchDetector:
    # Pickled by value: a task need not be able to import this module.
    pattern = r"(?<![A-Za-z0-9_])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9_])"

    def make_client():
        find = re.compile(pattern).finditer
        return lambda texts: [
            [("IP_ADDRESS", m.start(), m.end()) for m in find(t)] for t in texts
        ]

    return BatchDetector(make_client, hint=r"[0-9]\.[0-9]{1,3}\.[0-9]")


@query
def custom_detector(spark, sf_dir):
    chunks = entities.chunk_rows(v.documents(spark, sf_dir), "doc_id", ["text"])
    found = entities.detect_entities(chunks, python_ip_detector(), "doc_id")
    return found.select("doc_id", *_entity_columns())


@query
def custom_detector_deep(spark, sf_dir):
    docs = v.documents(spark, sf_dir).select("doc_id", "text")
    done = entities.redact_deep(docs, ["text"], detector=python_ip_detector())
    return done.select("doc_id", "text", count(), kinds())


@query
def custom_writer(spark, sf_dir):
    path = tables.workspace(spark, "audit")

    def to_parquet(records: DataFrame) -> None:
        records.write.partitionBy("status").parquet(path)

    tables.write_audit(_audited(spark, sf_dir), to_parquet)
    return spark.read.parquet(path).select(
        *_audit_row("call_id", "upstream_tool", "redaction_count", "status")
    )


# --- reports ----------------------------------------------------------------


@query
def pii_findings(spark, sf_dir):
    found = reports.pii_findings(v.texts(spark, sf_dir), "text_id", "text")
    return found.select(
        "text_id", "type", F.col("ordinal").cast("long").alias("ordinal"), "masked"
    )


@query
def pii_findings_deep(spark, sf_dir):
    found = reports.pii_findings_deep(v.leaf_documents(spark, sf_dir), "doc_id")
    return found.select(
        "doc_id", "path", "type", F.col("ordinal").cast("long").alias("ordinal"), "masked"
    )


@query
def redaction_summary(spark, sf_dir):
    done = redact.redact_text(v.documents(spark, sf_dir), "text", counts=True)
    return reports.redaction_summary(done, ["source"])


@query
def audit_summary(spark, sf_dir):
    done = calls.redact_calls(v.calls(spark, sf_dir))
    records = audit.audit_log(done, keep=("call_id", redact.COUNTS))
    return reports.redaction_summary(records, ["compliance_profile", "status"])
