"""Token counts of documents from the counts of their distinct pre-tokens.

No piece of the vocabulary has a space behind another character, so no merge crosses the
place before a run of spaces: the pieces of a text are those of its pre-tokens, each a run
of spaces with the characters behind it. Every distinct pre-token of the corpus is encoded
once. The most frequent ones, a bounded dictionary, are broadcast to where the documents'
pre-token frequencies are made; frequencies of all others are joined to their counts by a
shuffle. A pre-token outside the dictionary is rarer than every one of its ``COMMON``
entries, or long, so that no key of the join is hot.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.tables import Batches, named_apart, sliced, staged

LIMIT = 4096  # tokens
COMMON = 200_000  # entries of the broadcast dictionary
COMMON_CHARS = 32  # of an entry, at most
HELD = 300_000  # pre-tokens that a task holds before it hands on its counts
HELD_CHARS = 16 << 20
ADDED = ["n_bytes", "n_tokens", "over_limit"]

SPACE = "▁"  # what the vocabulary writes for a space; the same character in a text counts as one
_PRE_TOKEN = re.compile(" ( *[^ ]*)")


def pre_tokens(text: str | None) -> list[str]:
    """Pre-tokens, each without its first space (the text itself is read behind one)."""
    return _PRE_TOKEN.findall(" " + text.replace(SPACE, " ")) if text else []


def piece_counter(path: str) -> Callable[[str], int]:
    """Pre-token -> number of pieces, by the sentencepiece model at ``path``.

    A model whose pieces could cross pre-tokens is refused.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    if (
        model.trainer_spec.model_type != proto.TrainerSpec.BPE
        or rules.precompiled_charsmap or rules.normalization_rule_tsv
        or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces
        or model.trainer_spec.treat_whitespace_as_suffix
        or any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces)
        or any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces)
    ):
        raise ValueError(f"pre-tokens of {path} can't be counted one by one")
    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    lone = len(coder.encode("a ")) - len(coder.encode("a"))  # a single space at the end of a text

    def count(pre_token: str) -> int:
        return len(coder.encode(pre_token, num_threads=1)) if pre_token else lone

    return count


def _totals(batches: Batches) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    chars = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["pre_token", "n"]
        )

    for part in sliced(batches, 128):
        for text in part.column(0).to_pylist():
            if text:
                held.update(pre_tokens(text))
                chars += len(text)
        if len(held) > HELD or chars > HELD_CHARS and sum(map(len, held)) > HELD_CHARS:
            yield batch()
            held.clear()
        if chars > HELD_CHARS:
            chars = 0
    if held:
        yield batch()


def dictionary(texts: DataFrame, path: str) -> DataFrame:
    """``pre_token, n, pieces``: every distinct pre-token, encoded once."""
    totals = texts.mapInArrow(_totals, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        count = piece_counter(path)
        for batch in sliced(batches, 4096):
            pieces = pa.array([count(p) for p in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], ["pre_token", "n", "pieces"])

    return totals.mapInArrow(run, "pre_token string, n long, pieces long")


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    limit: int = LIMIT, common: int = COMMON,
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit``, a row for each row.

    Counts are those of the model over the whole text, without begin or end tokens; strings
    such as ``<s>`` in a text are ordinary text. A null or empty text has 0 bytes and 0
    tokens. Repeated rows and null ids are counted like others, however long a text is; an
    empty table gives no rows. Other columns are not read.
    """
    named_apart(id_col, ADDED)
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).alias("text")
    known = staged(dictionary(docs.select(text), path), "pre-tokens")
    short = known.where(F.char_length("pre_token") <= COMMON_CHARS)
    listed = short.orderBy(F.desc("n"), "pre_token").limit(common).select("pre_token", "pieces").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(
        dict(zip(listed.column(0).to_pylist(), listed.column(1).to_pylist()))
    )

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        rest_type = pa.map_(pa.string(), pa.int64())
        for batch in sliced(batches, 128):
            sums, rest = [], []
            for text in batch.column(1).to_pylist():
                frequencies = Counter(pre_tokens(text))
                total, others = 0, []
                for p, n in frequencies.items():
                    each = pieces.get(p)
                    if each is None:
                        others.append((p, n))
                    else:
                        total += each * n
                sums.append(total)
                rest.append(others)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sums, pa.int64()), pa.array(rest, rest_type)],
                ["id", "n_bytes", "common", "rest"],
            )

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    counted = docs.select(F.col(id_col).alias("id"), text, n_bytes.alias("n_bytes")).mapInArrow(
        run, f"id {id_type}, n_bytes long, common long, rest map<string,bigint>"
    )
    # Written with a number for each row: what is joined below names the rows as written.
    rows = staged(counted.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    others = rows.select("row", F.explode("rest").alias("pre_token", "n"))
    sums = (
        others.join(known.select("pre_token", "pieces"), "pre_token")
        .groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("others"))
    )
    n_tokens = F.col("common") + F.coalesce("others", F.lit(0))
    return (
        rows.select("row", "id", "n_bytes", "common").join(sums, "row", "left")
        .select(
            F.col("id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"),
            (n_tokens > limit).alias("over_limit"),
        )
    )
