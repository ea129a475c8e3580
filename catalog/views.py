"""Views over the given tables that hold what the operators work on.

Every view is a projection of whole tables: one output row per input row (or per
line of its text), nothing left out.  ``oracle.py`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.detectors import AnyDetector, PatternDetector, ip_detector
from hushframe.functions.patterns import LEFT, RIGHT
from hushframe.operators.profiles import PROFILES, Profile
from hushframe.sources.tables import read_table, spread

# Columns used here, stated so that no job has to read file footers for them.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
        "c_mktsegment string"
    ),
    "events": (
        "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    ),
    "benchmark": "item_id bigint, text string",
}

# Rules that stand in for an entity model.
SECRETS = PatternDetector("PASSWORD", LEFT + "[0-9a-f]{40}" + RIGHT)
NAMES = PatternDetector("NAME", LEFT + "[A-Z][a-z]{11,}" + RIGHT)
RULES = AnyDetector(ip_detector(), SECRETS, NAMES)

# The built-in profiles and one that switches the first stage off.
GATED = (*PROFILES, Profile("off", stage1=False, stage2=True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Where the caller sets ``hushframe.spread`` its rows are dealt to so
    many partitions; the small test tables are one file, hence one task, each."""
    df = read_table(spark, f"{sf_dir}/{name}.parquet", schema=SCHEMAS[name])
    partitions = spark.conf.get("hushframe.spread", None)
    return spread(df, int(partitions)) if partitions else df


# Tasks a core for tables of short rows.
TASKS = 4


def dealt(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """A table of short rows dealt over the cores by its key.

    Files give tasks by their bytes, or by their row groups: a million customers are 30 MB
    of Parquet, hence one task, though each row has as many texts to search as a long
    document. The rows are small, so the shuffle costs little beside that.
    """
    tasks = max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread(df, tasks, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with made-up contact data derived from their keys."""
    key = F.col("c_custkey")
    last4 = F.lpad(_text(key % 10000), 4, "0")
    return dealt(spark, table(spark, sf_dir, "customer"), "c_custkey").select(
        "c_custkey",
        "c_name",
        "c_acctbal",
        "c_mktsegment",
        F.concat(F.lit("4111 1111 1111 "), last4).alias("card"),
        F.concat(F.lit("NL91ABNA"), F.lpad(_text(key), 10, "0")).alias("iban"),
        F.concat_ws(
            "-",
            F.lpad(_text(key % 1000), 3, "0"),
            F.lpad(_text("c_nationkey"), 2, "0"),
            last4,
        ).alias("ssn"),
        F.concat(
            F.lit("customer."), _text(key), F.lit("@bank"), _text("c_nationkey"),
            F.lit(".example.com"),
        ).alias("email"),
        F.concat(F.lit("+31 6 "), last4, F.lit(" 5678")).alias("phone"),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select(
        "c_custkey",
        F.concat(
            F.col("c_name"), F.lit(" card "), F.col("card"), F.lit(", IBAN "),
            F.col("iban"), F.lit("; SSN "), F.col("ssn"), F.lit(" mail "),
            F.col("email"), F.lit(" tel "), F.col("phone"), F.lit("."),
        ).alias("contact"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All free text of the tables: text_id, text."""

    def part(name: str, df: DataFrame, key: list[str], column: str) -> DataFrame:
        ids = F.concat_ws(":", F.lit(name), *[_text(k) for k in key])
        return df.select(ids.alias("text_id"), F.col(column).alias("text"))

    return (
        part("documents", documents(spark, sf_dir), ["doc_id"], "text")
        .union(part("pages", table(spark, sf_dir, "pages"), ["page_id"], "html"))
        .union(
            part(
                "conversations",
                table(spark, sf_dir, "conversations"),
                ["conv_id", "turn"],
                "text",
            )
        )
        .union(part("benchmark", table(spark, sf_dir, "benchmark"), ["item_id"], "text"))
        .union(part("customer", contacts(spark, sf_dir), ["c_custkey"], "contact"))
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested customer records with every shape of value."""
    c = customers(spark, sf_dir)
    contact = F.struct(F.col("email"), F.col("ssn"))
    return c.select(
        "c_custkey",
        F.col("c_acctbal").alias("balance"),
        (F.col("c_acctbal") > 0).alias("active"),
        F.struct(
            F.col("c_custkey").alias("id"), contact.alias("contact")
        ).alias("user"),
        F.array(
            F.col("email"), F.lit(None).cast("string"),
            F.concat(F.lit("alt."), F.col("email")),
        ).alias("emails"),
        F.create_map(F.col("email"), F.col("phone"), F.lit("iban"), F.col("iban")).alias(
            "attrs"
        ),
        F.array(
            F.struct(
                F.col("card"),
                F.col("c_acctbal").alias("amount"),
                F.concat(F.lit("ref "), F.col("ssn"), F.lit(" "), F.col("email")).alias(
                    "note"
                ),
            ),
            F.struct(
                F.lit(None).cast("string").alias("card"),
                F.lit(0.0).alias("amount"),
                F.col("c_name").alias("note"),
            ),
        ).alias("payments"),
        F.lit(None).cast("string").alias("nothing"),
    )


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text of mixed shape: customer documents and event properties."""
    c = customers(spark, sf_dir)
    made = c.select(
        F.concat(F.lit("customer:"), _text("c_custkey")).alias("doc_id"),
        F.concat(
            F.lit('{"id": '), _text("c_custkey"),
            F.lit(', "user": {"email": "'), F.col("email"),
            F.lit('", "ssn": "'), F.col("ssn"),
            F.lit('"}, "cards": ["'), F.col("card"),
            F.lit('", null, 4111111111111111], "amount": 1500.0, "x@y.zz": "'),
            F.col("phone"), F.lit('"}'),
        ).alias("doc"),
    )
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("event:"), _text("event_id")).alias("doc_id"),
        F.col("props").alias("doc"),
    )
    return made.union(events)


def leaf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nested records: a body, its lines and some fields."""
    return as_leaf_documents(documents(spark, sf_dir))


def as_leaf_documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.struct("lang", F.col("text").alias("body"), "n_chars").alias("page"),
        F.split("text", "\n", -1).alias("lines"),
        F.create_map(F.lit("source"), F.col("source")).alias("tags"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_calls(documents(spark, sf_dir))


def as_calls(docs: DataFrame) -> DataFrame:
    """One tool call per document, one content block per line.

    Derived in the row, so a document's copies or a hot source never meet in one
    task.
    """
    key = F.col("doc_id")
    blocks = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.struct(
            F.when(i % 5 == 4, "image").otherwise("text").alias("type"),
            F.when(i % 5 != 4, line).alias("text"),
            F.when(i % 5 == 4, line).alias("data"),
            F.when(i % 5 == 4, "image/png").alias("mimeType"),
        ),
    )
    millis = F.lit(1704067200000) + key * 1000 + key % 997
    return docs.select(
        key.alias("call_id"),
        F.col("source").alias("tool_name"),
        F.when(
            key % 13 != 0,
            F.concat(
                F.lit('{"query":"user'), _text(key), F.lit("@mail"), _text(key % 7),
                F.lit('.example.com","ids":"'),
                F.repeat(F.concat(F.lit("k"), _text(key), F.lit("-")), (key % 120).cast("int")),
                F.lit('"}'),
            ),
        ).alias("arguments"),
        F.timestamp_millis(millis).alias("started_at"),
        F.timestamp_millis(millis + 45 + key % 900).alias("finished_at"),
        F.when(
            key % 23 == 0,
            F.concat(F.lit("upstream down for ops"), _text(key), F.lit("@example.com")),
        ).alias("failure"),
        F.element_at(
            F.array(*[F.lit(p) for p in ("GDPR", "DORA", "PCI_DSS", "full", "UNKNOWN")]),
            (key % 5 + 1).cast("int"),
        ).alias("profile"),
        (key % 17 == 0).alias("is_error"),
        F.when((key % 29 == 0) | (key % 23 == 0), F.lit(None))
        .when(key % 31 == 0, F.slice(blocks, 1, 0))
        .otherwise(blocks)
        .alias("content"),
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resource read per page: the page, or a blob of it, and its address."""
    blob = F.col("page_id") % 7 == 0
    null = F.lit(None).cast("string")

    def item(mime: str, text: Column, data: Column) -> Column:
        return F.struct(
            F.col("url").alias("uri"),
            F.lit(mime).alias("mimeType"),
            text.alias("text"),
            data.alias("blob"),
        )

    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.col("url").alias("uri"),
        F.element_at(
            F.array(*[F.lit(p) for p in ("GDPR", "DORA", "PCI_DSS", "full", "UNKNOWN")]),
            (F.col("page_id") % 5 + 1).cast("int"),
        ).alias("profile"),
        F.array(
            item("text/html", F.when(~blob, F.col("html")), F.when(blob, F.col("html"))),
            item(
                "text/plain",
                F.concat(F.lit("seen by user"), _text("page_id"), F.lit("@example.com")),
                null,
            ),
        ).alias("contents"),
    )
