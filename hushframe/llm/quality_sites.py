"""Quality classifier: document evidence and the record of a document's site.

Hierarchical empirical Bayes. A document classifier (logistic regression on hashed
n-grams and a few ratios, fitted to a bounded labelled sample) gives each document its
own evidence. Sites are judged by grouped sums over all documents: a document counts with
its classifier's probability, a labelled one with its label. Host rates are shrunk
towards the global rate by a prior strength estimated from the spread between hosts, path
rates towards their host's, so a sparse site says little and a rich one much. The
posterior odds of a document are its own odds, moved by those of its path against the
global prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm import linear
from hushframe.llm.hashing import WordHashes, words
from hushframe.llm.quality_rules import counts, ngrams, summed
from hushframe.llm.tables import Batches, named_apart, sliced, staged

KEEP = 0.5  # posterior probability from which a document is kept
SITE_WEIGHT = 0.5  # of a site's log odds against the document's own
STRENGTH = (1.0, 200.0)  # least and most documents that a prior is worth
PATH_STRENGTH = 50.0  # documents that a host's rate is worth to its paths
EXTRA = 6  # ratios behind the hashed features
RESULT = ["document_score", "host_posterior", "path_posterior", "score", "kept"]


def ratios(text: str | None, h: np.ndarray) -> np.ndarray:
    """Shares of repeats, symbols, doubled lines, capitals and neighbours that are equal."""
    n, chars, symbols, lines, again = counts(text, h)
    text = text or ""
    upper = sum(map(str.isupper, text))
    twins = int((h[1:] == h[:-1]).sum()) if n > 1 else 0
    return np.array(
        [
            again / max(n, 1), min(1.0, symbols / max(chars, 1) * 10), lines / (text.count("\n") + 1),
            upper / max(chars, 1), twins / max(n, 1), 1.0 - len(np.unique(h)) / max(n, 1),
        ],
        np.float32,
    ) * 5


def document_features():
    seen = WordHashes()
    extra = np.arange(1 << linear.BITS, (1 << linear.BITS) + EXTRA)

    def of(text: str | None, each: bool = False) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        h = seen.of(words(text))
        index, value = ngrams(raw, h)
        if not each:
            index, value = summed(index, value)
        return np.concatenate((index, extra)), np.concatenate((value, ratios(text, h)))

    return of


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = linear.SAMPLE) -> linear.Model:
    labelled = linear.sample(docs, labels, id_col, text_col, label, rows)
    return linear.fit(labelled, document_features(), (1 << linear.BITS) + EXTRA)


def document_scores(docs: DataFrame, model: linear.Model, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """``doc, id, host, path, p``: the classifier's probability for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())  # 2 ** BITS weights

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        model, features = linear.Model(*sent.value), document_features()
        for batch in sliced(batches):
            logits = [model.logit(*features(t, True)) for t in batch.column(4).to_pylist()]
            p = pa.array(linear.sigmoid(np.array(logits)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], p], ["doc", "id", "host", "path", "p"])

    # Null hosts and paths are sites of their own.
    rows = docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("doc"), F.col(id_col).alias("id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(run, f"doc long, id {id_type}, host string, path string, p double")


def site_posteriors(scores: DataFrame, labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """``host, path, prior, host_posterior, path_posterior`` from grouped sums."""
    known = (
        labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.avg(label).alias("label"))
    )
    evidence = scores.join(known, "id", "left").select("host", "path", F.coalesce("label", "p").alias("y"))
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("good"))
    paths = staged(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    # Global sums: two numbers of all hosts, one row.
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hgood").alias("good"), F.count("*").alias("hosts")).first()
    prior = (float(total["good"] or 0) + 1.0) / (float(total["n"] or 0) + 2.0)
    rate = F.col("hgood") / F.col("hn")
    # Method of moments: the spread of host rates beyond that of binomial draws.
    spread = hosts.agg(
        F.avg((rate - prior) ** 2 - prior * (1 - prior) / F.col("hn")).alias("between")
    ).first()["between"]
    between = max(float(spread or 0.0), 0.0)
    least, most = STRENGTH
    strength = most if between <= 0 else float(np.clip(prior * (1 - prior) / between - 1, least, most))
    host = (F.col("hgood") + strength * prior) / (F.col("hn") + strength)
    hosts = hosts.select("host", host.alias("host_posterior"))
    path = (F.col("good") + PATH_STRENGTH * F.col("host_posterior")) / (F.col("n") + PATH_STRENGTH)
    return paths.join(hosts, "host").select("host", "path", F.lit(prior).alias("prior"), "host_posterior", path.alias("path_posterior"))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _posteriors(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, label: str, rows: int) -> DataFrame:
    model = train(docs, labels, id_col, text_col, label, rows)
    scores = staged(document_scores(docs, model, id_col, text_col, host_col, path_col), "scores")
    sites = staged(site_posteriors(scores, labels, label, id_col), "sites")
    odds = _logit(F.col("p")) + SITE_WEIGHT * (_logit(F.col("path_posterior")) - _logit(F.col("prior")))
    score = 1 / (1 + F.exp(-odds))
    return scores.join(sites, ["host", "path"]).select(
        "doc", "id", "host", "path", F.col("p").alias("document_score"), "host_posterior", "path_posterior",
        score.alias("score"), (score >= KEEP).alias("kept"),
    )


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", label: str = "quality", rows: int = linear.SAMPLE,
) -> DataFrame:
    """``id_col, document_score, host_posterior, path_posterior, score, kept`` per row.

    ``score`` is the posterior probability of good quality, kept from ``KEEP`` on. A null
    text is an empty one; a null host or path is a site of its own; repeated rows and
    null ids each give their row; without labels of both kinds every document has the
    same evidence; an empty table gives an empty result. Other columns are not read.
    """
    named_apart(id_col, RESULT)
    found = _posteriors(docs, labels, id_col, text_col, host_col, path_col, label, rows)
    return found.select(F.col("id").alias(id_col), *RESULT)


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", label: str = "quality", rows: int = linear.SAMPLE,
) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps; all columns are kept, whatever their names.

    Rows equal in id and text share their verdict, that of the better site.
    """
    found = _posteriors(docs, labels, id_col, text_col, host_col, path_col, label, rows)
    bad = found.groupBy(F.col("doc").alias("_doc")).agg(F.max("kept").alias("_kept")).where("not _kept").select("_doc")
    # The rejected rows grow with the corpus: merged at every size, never broadcast.
    bad = staged(bad, "rejected").hint("merge")
    return docs.join(bad, F.xxhash64(docs[id_col], docs[text_col]) == bad["_doc"], "left_anti")
