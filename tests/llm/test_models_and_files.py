import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import linear, quality_rules, quality_sites, sharding, tables, toxicity, warc
from hushframe.llm.hashing import WordHashes
from hushframe.llm.queries import QUERIES
from tests.llm import brute

LABELS = "doc_id long, quality int, toxic int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- quality rules ----------------------------------------------------------


def test_counts_as_brute_force(spark, sf_dir, odd_docs):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for text in texts + [r[1] for r in odd_docs]:
        h = WordHashes().of(quality_rules.words(text))
        assert quality_rules.counts(text, h) == brute.quality_counts(text)


def labelled(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def accuracy(verdicts, labels, column, label, only=None):
    both = verdicts.join(labels, "doc_id").select("doc_id", F.col(column).cast("int").alias("v"), F.col(label).alias("y")).collect()
    both = [r for r in both if only is None or only(r["doc_id"])]
    return sum(r["v"] == r["y"] for r in both) / len(both), len(both)


def test_quality_rules_on_rows_not_fitted():
    """Held-out accuracy is tested on the larger table below; here the model's parts."""
    index, value = quality_rules.ngrams(b"ab cd", WordHashes().of([b"ab", b"cd"]))
    assert len(index) == 3 + (4 + 3 + 2) and math.isclose(value.sum(), 2 * quality_rules.SCALE, rel_tol=1e-5)
    assert len(quality_rules.ngrams(b"", WordHashes().of([]))[0]) == 0


@pytest.fixture(scope="module")
def middle():
    return "/root/testdata/sf0.01"


def test_quality_rules_find_junk(spark, middle):
    docs, labels = labelled(spark, middle)
    # Fitted to a part of the labels, judged on the rest.
    part = labels.where("doc_id % 3 <> 0")
    model = quality_rules.train(docs, part)
    got = quality_rules.judge(docs, model).cache()
    share, n = accuracy(got.where("not base_failed"), labels, "kept", "quality", lambda i: i % 3 == 0)
    assert n > 80 and share > 0.97
    for r in got.collect():
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["score"] >= 0.5)


def test_quality_rules_on_odd_rows(spark, odd, odd_docs, nothing):
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0), (14, 0, 0), (15, 0, 0), (None, 1, 1), (3, None, None), (9, 0, 1), (9, 1, 1)], LABELS)
    model = quality_rules.train(odd, labels)
    got = quality_rules.judge(odd, model).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_docs)
    assert all(0 <= r["score"] <= 1 for r in got)
    none = quality_rules.train(odd, labels.limit(0))
    assert {round(r["score"], 6) for r in quality_rules.judge(odd, none).collect()} == {0.5}
    assert quality_rules.judge(nothing, none).collect() == []


def test_calibration_and_fit_are_repeatable(spark, middle):
    docs, labels = labelled(spark, middle)
    a, b = (quality_rules.train(docs, labels, rows=120) for _ in range(2))
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.shift) == (b.slope, b.shift)
    x = np.random.default_rng(0).normal(0, 2, 4000)
    y = (np.random.default_rng(1).random(4000) < linear.sigmoid(0.5 * x - 1)).astype(float)
    slope, shift = linear.calibrate(x, y)
    assert abs(slope - 0.5) < 0.1 and abs(shift + 1) < 0.15


# --- quality by site --------------------------------------------------------


def test_sites_are_shrunk(spark):
    rows = [(i, "rich", "a", 0.9) for i in range(400)] + [(i, "rich", "b", 0.9) for i in range(400, 402)]
    rows += [(i, "poor", "a", 0.1) for i in range(500, 900)] + [(1000, "tiny", "a", 0.1)]
    scores = spark.createDataFrame([(i, i, h, p, v) for i, h, p, v in rows], "doc long, id long, host string, path string, p double")
    labels = spark.createDataFrame([(400, 0, 0), (401, 0, 0)], LABELS)
    got = {(r["host"], r["path"]): r for r in quality_sites.site_posteriors(scores, labels, "quality", "doc_id").collect()}
    prior = got["rich", "a"]["prior"]
    assert abs(prior - (400 * 0.9 + 0 + 401 * 0.1 + 1) / 805) < 1e-9
    assert got["rich", "a"]["host_posterior"] > 0.85 and got["poor", "a"]["host_posterior"] < 0.15
    assert abs(got["tiny", "a"]["host_posterior"] - prior) < abs(0.1 - prior)
    b = got["rich", "b"]  # two bad labels move the path a little from its host
    assert abs(b["path_posterior"] - (0 + 50 * b["host_posterior"]) / 52) < 1e-9


def test_site_classifier_keeps_clean_documents(spark, middle):
    docs, labels = labelled(spark, middle)
    got = quality_sites.classify(docs, labels.where("doc_id % 3 <> 0")).cache()
    share, n = accuracy(got, labels, "kept", "quality", lambda i: i % 3 == 0)
    assert n > 100 and share > 0.95
    kept = quality_sites.keep_good(docs.withColumn("score", F.lit(1)), labels)
    assert kept.columns == [*docs.columns, "score"]
    assert rows_of(kept.select("doc_id")) == rows_of(quality_sites.classify(docs, labels).where("kept").select("doc_id"))


def test_site_classifier_on_odd_rows(spark, odd, odd_docs, nothing):
    labels = spark.createDataFrame([(7, 1, 0), (14, 0, 0), (15, 0, 0), (8, 1, 1)], LABELS)
    got = quality_sites.classify(odd, labels).collect()
    assert len(got) == len(odd_docs) and all(r["kept"] == (r["score"] >= 0.5) for r in got)
    none = labels.limit(0)
    assert quality_sites.classify(odd, none).where("not kept").count() == 0
    assert quality_sites.keep_good(odd, none).count() == len(odd_docs)
    assert quality_sites.classify(nothing, labels).collect() == []


# --- toxicity ---------------------------------------------------------------


def test_block_max_search_is_exact():
    rng = random.Random(8)
    rows = []
    for _ in range(500):
        c = Counter({rng.randrange(60): rng.randrange(1, 5) for _ in range(rng.randrange(0, 6))})
        rows.append(toxicity.vector(c, np.linspace(0.5, 3, 60)))
    labels = np.array([rng.randrange(2) for _ in rows], np.float64)
    index = toxicity.Index(list(range(500)), labels, rows, 60)
    dense = np.zeros((500, 60))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for i in range(0, 500, 7):
        t, w = rows[i]
        if not len(t):
            continue
        near = index.nearest(t, w, 10)
        every = dense @ dense[i]
        want = sorted(every[every > 0], reverse=True)[:10]
        assert np.allclose([s for s, _ in near], want)
        assert all(math.isclose(every[index.ids[-p]], s) for s, p in near)


def test_bounds_leave_blocks_out():
    """Examples of several vocabularies: most blocks are never finished, nothing is lost."""
    rng = random.Random(18)
    width, rows = 240, []
    for i in range(1600):
        base = 40 * (i % 6)
        c = Counter(base + min(39, int(rng.expovariate(0.1))) for _ in range(rng.randrange(3, 40)))
        rows.append(toxicity.vector(c, np.linspace(0.5, 3, width)))
    rows[700] = rows[1300] = rows[100]  # copies go by position
    dense = np.zeros((len(rows), width))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    index = toxicity.Index(list(range(len(rows))), np.zeros(len(rows)), rows, width)
    asked = list(range(0, len(rows), 25))
    found = index.search([rows[i] for i in asked], 16)
    alone = index.search([rows[i] for i in asked], 16, asked)
    for i, near, rest in zip(asked, found, alone):
        every = dense @ dense[i]
        assert np.allclose([s for s, _ in near], np.sort(every)[::-1][:16])
        assert rest == [x for x in index.search([rows[i]], 17)[0] if x[1] != -i][:16]
    assert [-p for _, p in found[asked.index(100)][:3]] == [100, 700, 1300]
    assert index.finished < 0.6 * index.searched
    empty = toxicity.vector({}, np.ones(width))
    assert index.search([empty], 16) == [[]]


def test_sample_is_taken_among_the_documents(spark):
    docs = spark.range(50).select((F.col("id") * 2000).alias("doc_id"), F.lit("a").alias("text"))
    labels = spark.range(100_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("quality"))
    got = linear.sample(docs, labels, "doc_id", "text", "quality", rows=40).collect()
    assert len(got) == 40 and len({r["id"] for r in got}) == 40
    # An id of many rows gives one, whatever the order.
    many = spark.range(10_000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 90 + 10).alias("text"))
    many = many.union(spark.createDataFrame([(7, None), (8, None)], "doc_id int, text string"))
    for rows in (many, many.repartition(5)):
        got = linear.sample(rows, labels, "doc_id", "text", "quality", rows=2).collect()
        assert sorted(map(tuple, got)) == [(7, "t10", 0), (8, None, 0)]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = labelled(spark, sf)
    got = toxicity.score(docs, labels).cache()
    for r in got.select("doc_id", "held_out").collect():
        assert r["held_out"] == brute.held_out(r["doc_id"])
    share, n = accuracy(got, labels, "predicted", "toxic", brute.held_out)
    assert n > 500 and share > 0.96
    # Labels of held-out rows play no part.
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(docs, changed)
    assert rows_of(got.select("doc_id", "score")) == rows_of(again.select("doc_id", "score"))


def test_toxicity_finds_copies_without_words_of_the_class(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=30))) for i in range(200)]
    toxic = {i for i in range(200) if i % 40 == 7 and not brute.held_out(i)}
    copied = {next(j for j in range(1000 + 50 * i, 1050 + 50 * i) if brute.held_out(j)): i for i in toxic}
    docs = spark.createDataFrame(rows + [(j, rows[i][1]) for j, i in copied.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, int(i in toxic)) for i, _ in rows], LABELS)
    assert toxic
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    for j, i in copied.items():
        first = got[j]["evidence"][0]
        assert first["id"] == str(i) and math.isclose(first["similarity"], 1.0)
        assert got[j]["score"] > max(r["score"] for k, r in got.items() if k not in toxic and k not in copied)


def test_toxicity_on_odd_rows(spark, odd, odd_docs, nothing):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(20)] + [(None, 1, 1), (6, 0, 1)], LABELS)
    got = toxicity.score(odd, labels).collect()
    assert len(got) == len(odd_docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    alone = toxicity.score(odd, labels.limit(0)).collect()
    assert {r["score"] for r in alone} and all(r["evidence"] == [] for r in alone)
    assert toxicity.score(nothing, labels).collect() == []


# --- archives ---------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def pages(spark):
    same = "<p>again</p>" * 20
    rows = [(i, f"http://h/{i}", f"<html>{i}" + "é" * i) for i in range(30)]
    rows += [(50, "http://a b\r\n/", same), (40, None, same), (60, "u", same), (70, "u", "short"), (71, "u", "short")]
    rows += [(80, "u", None), (81, None, ""), (82, "u", "x" * 99), (83, "u", "x" * 99), (84, "u", "y" * 100), (85, "v", "y" * 100)]
    rows += [(86, "u", "\r\n\r\n--" * 30)]
    return rows


def test_archive_round_trip(spark, tmp_path):
    rows = pages(spark)
    folder = str(tmp_path / "w")
    manifest = warc.write(spark.createDataFrame(rows, PAGES), folder, roll=2000)
    assert manifest.count() > 2  # rolled
    got = warc.read(spark, folder).collect()
    digests = sorted((r["id"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"]) for r in got)
    assert [tuple(map(str, d)) for d in digests] == [tuple(map(str, d)) for d in sorted(brute.archive([(i, h) for i, _, h in rows]), key=lambda r: r[0])]
    html = {i: h or "" for i, _, h in rows}
    assert all(bytes(r["payload"]).decode() == html[r["id"]] for r in got if r["type"] == "response")
    # Nothing is left under temporary names, and equal tables give equal files.
    assert list((tmp_path / "w" / "_temporary").iterdir()) == []
    other = str(tmp_path / "v")
    warc.write(spark.createDataFrame(rows[::-1], PAGES).repartition(5), other, roll=2000)
    files = {p.name: p.read_bytes() for p in (tmp_path / "w").glob("*.gz")}
    assert files == {p.name: p.read_bytes() for p in (tmp_path / "v").glob("*.gz")}
    for r in manifest.collect():
        assert hashlib.sha256(files[r["file"]]).hexdigest() == r["sha256"] and len(files[r["file"]]) == r["bytes"]


def test_archive_in_shards_of_key_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD", 4000)
    rows = [(i * 17, "u", "z" * 1000 + str(i)) for i in range(60)]
    manifest = warc.write(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/s").collect()
    spans = sorted((r["first"], r["last"], r["shard"]) for r in manifest)
    assert len(spans) > 5 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert sum(r["records"] for r in manifest) == 60


def test_archive_of_repeated_rows_and_null_ids(spark, tmp_path):
    same = "q" * 150
    rows = [(5, "u", same), (5, "u", same), (7, "u", same), (None, "u", same), (None, "u", "r" * 200), (None, "u", "r" * 200)]
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("mine")).withColumn("shard", F.lit(9))
    warc.write(df, str(tmp_path / "n"))
    got = warc.read(spark, str(tmp_path / "n")).collect()
    kinds = Counter((r["id"], r["type"], r["refers_to"]) for r in got)
    assert kinds == {(5, "response", None): 1, (5, "revisit", 5): 1, (7, "revisit", 5): 1, (None, "revisit", 5): 1, (None, "response", None): 2}
    warc.write(spark.createDataFrame([], PAGES), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).collect() == []


def test_damage_is_found(spark, tmp_path):
    warc.write(spark.createDataFrame(pages(spark), PAGES), str(tmp_path / "d"))
    path = next((tmp_path / "d").glob("*.gz"))
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 1
    path.write_bytes(data)
    (tmp_path / "d" / f".{path.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="manifest"):
        warc.read(spark, str(tmp_path / "d")).collect()


# --- shards -----------------------------------------------------------------


def placed(spark, n, regions, keys=3000):
    df = spark.range(keys)
    return {r["id"]: r["s"] for r in df.select("id", sharding.shard_of(F.col("id"), regions).alias("s")).collect()}


@pytest.mark.parametrize("n", [1, 5, 8, 24, 25, 26])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    before, after = placed(spark, n, sharding.tree(n)), placed(spark, n + 1, sharding.tree(n + 1))
    moved = {k for k in before if before[k] != after[k]}
    assert {after[k] for k in moved} == {n}
    assert 0.5 < len(moved) * (n + 1) / 3000 < 1.6
    assert set(before.values()) == set(range(n))


def test_weights_confine_movement(spark):
    tree = [[{0: 1.0, 1: 1.0}, {2: 1.0}], [{3: 1.0, 4: 1.0}]]
    heavier = [[{0: 1.0, 1: 3.0}, {2: 1.0}], [{3: 1.0, 4: 1.0}]]
    lighter = [[{0: 1.0, 1: 0.0}, {2: 1.0}], [{3: 1.0, 4: 1.0}]]
    a, b, c = (placed(spark, 5, t) for t in (tree, heavier, lighter))
    assert {b[k] for k in a if a[k] != b[k]} == {1}
    assert {a[k] for k in a if a[k] != c[k]} == {1}
    assert abs(sum(s == 1 for s in b.values()) / 3000 - 3 / 7) < 0.04


def test_slots_are_gapless(spark, odd):
    many = odd.withColumn("slot", F.lit("mine")).withColumn("bucket", F.lit(1))
    for bucket in (1, 20_000):
        got = sharding.assign(many, "doc_id", sharding.tree(3), order=["text"], bucket=bucket).collect()
        assert len(got) == odd.count()
        slots = {}
        for r in got:
            slots.setdefault(r["shard"], []).append(r["slot"])
            assert r["slot_input"] == "mine" and r["bucket"] == 1 and r["grown_shard"] is None
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(odd.limit(0), "doc_id", sharding.tree(3)).collect() == []


def test_shards_of_the_query(spark, sf_dir):
    import zlib

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op9_sharding"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)


# --- helpers ----------------------------------------------------------------


def test_set_aside_and_staging(spark, odd):
    df = spark.createDataFrame([(1, 2, 3)], "slot int, Slot_input int, x int")
    assert tables.set_aside(df, ["SLOT"]).columns == ["_slot_input", "Slot_input", "x"]
    assert tables.free_name(["a", "_A"], "a") == "__a"
    assert rows_of(tables.staged(odd, "t")) == rows_of(odd)
    with pytest.raises(ValueError, match="result column"):
        tables.named_apart("Score", ["score"])


def test_toxicity_words_are_the_same_with_and_without_the_pattern():
    texts = [f"{chr(c)}Ab{chr(c)}{chr(c)}c9d" for c in range(128)] + ["", "one_two\x1cthree", "No Breaks", "naïve Straße_x"]
    for text in texts:
        assert toxicity.word_list(text) == toxicity._WORD.findall(text.lower())
    assert toxicity.word_list(None) == []
