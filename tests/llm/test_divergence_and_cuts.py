"""Source divergence, fill-in-the-middle and token counts."""

import gc
import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from hushframe.llm import divergence, fillmiddle, perfecthash, tokencounts
from hushframe.llm.tables import read
from tests.llm.conftest import DDL
from tests.llm.test_text_operators import same

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- perfect hashes ---------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_perfect_hash_numbers_its_keys_and_no_others(n):
    keys = [b"key%d" % i for i in range(n)]
    bits, sizes, order = perfecthash.build(keys)
    assert sorted(order) == list(range(n))
    stored = [keys[i] for i in order]
    found = perfecthash.PerfectHash(bits, sizes, stored)
    assert found.numbers(stored, perfecthash.hashes(stored)).tolist() == list(range(n))
    others = [b"other%d" % i for i in range(2000)]
    assert set(found.numbers(others, perfecthash.hashes(others)).tolist()) == {-1}


def test_keys_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(perfecthash, "hashes", lambda keys: np.array([hash(k) % 3 for k in keys], np.uint64))
    keys = [b"k%d" % i for i in range(30)]
    bits, sizes, order = perfecthash.build(keys)
    stored = [keys[i] for i in order]
    found = perfecthash.PerfectHash(bits, sizes, stored)
    words = [*stored, b"none"]
    assert found.numbers(words, perfecthash.hashes(words)).tolist() == [*range(30), -1]


def test_shards_are_those_that_spark_deals(spark):
    keys = ["a", "é漢", "word"]
    shard = F.shiftrightunsigned(F.xxhash64("k"), 1) % F.lit(7)
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(shard).collect()]
    assert got == perfecthash.shard_of(perfecthash.hashes([k.encode() for k in keys]), 7).tolist()


# --- source divergence ------------------------------------------------------


def brute_audit(rows, min_docs=3, ranks=200):
    docs = defaultdict(Counter)
    counts = defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = TERM.findall(low)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            above = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", above)):
                best = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, t, v, i + 1) for i, (v, t) in enumerate(best) if part == "pair" or i < ranks]
    return out


def test_audit_as_brute_force(odd, odd_docs, spark):
    rng = random.Random(3)
    rows = [(r[1], r[2], r[3]) for r in odd_docs]
    rows += [(" ".join(rng.choices("Aa bB cc dé 漢字 x9y it's".split(), k=30)), rng.choice(["en", "de", None, ""]), f"s{rng.randrange(5)}") for _ in range(80)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("rank", F.lit(1))
    same(divergence.audit(df).collect(), brute_audit(rows))
    same(divergence.audit(df, ranks=2).collect(), brute_audit(rows, ranks=2))


@pytest.mark.parametrize("bound", [0, 5_000, 20_000])
def test_terms_beyond_the_broadcast_bound_are_joined(spark, sf_dir, bound, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD", 20)
    monkeypatch.setattr(divergence, "PAGE", 16)
    monkeypatch.setattr(divergence, "TILE", 2)
    docs = read(spark, sf_dir, "documents").limit(60).cache()
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    kept = divergence.kept_terms(divergence._inputs(docs, "lang", "source", "text"))
    found = divergence.perfect_hashes(kept, bound)
    assert found.where("NOT dense").count() and (found.where("dense").count() > 0) == (bound > 0)
    same(divergence.audit(docs, bound=bound).collect(), brute_audit(rows))


def test_audit_of_wide_tables_and_of_nothing(spark, nothing):
    assert divergence.audit(nothing).count() == 0
    rows = [("same words here", "en", f"s{i:03}") for i in range(150)] + [("rare", "xx", "only")]
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"))
    same(got.collect(), brute_audit(rows))  # more than two tiles; a language without kept terms


def test_occurrences_are_the_terms_of_each_row(monkeypatch):
    monkeypatch.setattr(divergence, "PART_BYTES", 64)
    rng = random.Random(5)
    texts = ["".join(rng.choices("aaZé漢😀 \t\n\x00\x0b\x1c\x7f\u0085\u00a0\u20039'_", k=rng.randrange(90))) for _ in range(200)]
    texts += ["", " ", "one"]
    langs = [rng.choice(["en", "de", ""]) for _ in texts]
    batch = pa.record_batch([pa.array(langs), pa.array(texts)], ["lang", "text"])
    got = defaultdict(list)
    for lang, rows, part, sizes, places, listed in divergence.occurrences(iter([batch.slice(3), batch.slice(0, 0)])):
        words = listed.take(pa.array(places)).to_pylist()
        ends = np.cumsum(sizes).tolist()
        assert len(words) == ends[-1] and len(rows) == len(ends) and "" not in words
        got[lang] += [words[a:b] for a, b in zip([0, *ends], ends)]
    want = defaultdict(list)
    for lang, text in list(zip(langs, texts))[3:]:
        want[lang].append(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    assert got == want


def test_words_are_counted_alike_however_often_a_task_begins_anew(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(" ".join(rng.choices([f"w{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(200)], k=40)), rng.choice(["en", "de"]), f"s{i % 3}") for i in range(90)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    for name, most in (("NUMBERED", 50), ("OCCURRENCES", 100), ("PAGES", 1)):
        monkeypatch.setattr(divergence, name, most)
        for bound in (divergence.BROADCAST, 3_000):
            same(divergence.audit(df, bound=bound).collect(), brute_audit(rows))


def test_a_task_hands_on_one_batch_for_each_group(monkeypatch):
    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(divergence, "PAGE", 4)
    keys = [b"k" + b"a" * i for i in range(40)]
    bits, sizes, order = perfecthash.build(keys)

    class Sent:
        value = {"en": [(0, 1, 0, bits, sizes, [keys[i] for i in order])]}

    text = " ".join(k.decode() for k in keys)
    columns = [pa.array(["en"] * 6), pa.array(["s", "t"] * 3), pa.array([text] * 6)]
    out = list(divergence.recount(Frame(), Sent, False)(iter([pa.record_batch(columns, ["lang", "source", "text"])])))
    assert [(b.num_rows, set(b.column(1).to_pylist()), set(b.column(4).to_pylist())) for b in out] == [(40, {"s"}, {3}), (40, {"t"}, {3})]


@pytest.mark.parametrize("again", [False, True])
def test_a_reused_worker_keeps_no_words_of_earlier_tasks(again):
    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    class Sent:
        value = {}

    def task(k):
        words = [chr(97 + k) + "".join(chr(97 + i // 26**j % 26) for j in range(4)) for i in range(20_000)]
        columns = {"lang": ["en"], "source": ["s"], "text": [" ".join(words)]}
        batch = pa.RecordBatch.from_pydict(columns if again else {c: columns[c] for c in ("lang", "text")})
        run = divergence.recount(Frame(), Sent, True) if again else divergence._document_counts
        return sum(b.num_rows for b in run(iter([batch])))

    held = []
    gc.collect()
    gc.disable()  # a worker's few containers rarely bring it to a full collection
    tracemalloc.start()
    try:
        for k in range(5):
            assert task(k) == 20_000
            held.append(tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
        gc.enable()
    assert held[-1] - held[0] < 1_000_000


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}

    def staged(df, step, own=divergence.staged):
        seen[step] = int(spark.conf.get(name))
        return own(df, step)

    monkeypatch.setattr(divergence, "staged", staged)
    before = spark.conf.get(name)
    rows = [("same words here", "en", f"s{i}") for i in range(4)]
    try:
        for given, used in ((10_000, divergence.BATCH_ROWS), (0, divergence.BATCH_ROWS), (7, 7)):
            spark.conf.set(name, given)
            same(divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string")).collect(), brute_audit(rows))
            assert (seen["terms"], seen["counts"], int(spark.conf.get(name))) == (used, used, given)
    finally:
        spark.conf.set(name, before)


def test_large_counts_stay_exact():
    counts = np.array([0, 10**10, 3 * 10**12], np.int64)
    totals = np.array([10, 10**12, 4 * 10**12], np.int64)
    assert divergence._shares(counts, totals).tolist() == [
        1 + 10**9 * (c + 1) // t for c, t in zip(counts.tolist(), totals.tolist())
    ]


# --- fill in the middle -----------------------------------------------------


def brute_cut(i, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return i, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(rng):
    yield from ("", " ", "a", " a", "a ", " ", "a b \t", "<P", "P> <", "😀 x 😀", "a" * 70_000, "a " * 40_000, " " * 66_000)
    for n in (65_535, 65_536, 65_537, 131_072):
        yield "".join(rng.choices("ab \n😀", k=n))
        yield " " * (n - 1) + "x"
        yield "x" * (n - 1) + " "


def test_boundaries_are_the_ends_of_tokens():
    rng = random.Random(4)
    kinds = set()
    for text in texts(rng):
        ends = [m.end() for m in TOKEN.finditer(text)]
        bounds = fillmiddle.Boundaries(text)
        kinds |= {type(c).__name__ for c in bounds.containers}
        assert bounds.n == len(ends)
        for k in {0, len(ends), *(rng.randrange(len(ends) + 1) for _ in range(300))}:
            assert bounds.offset(k) == (ends[k - 1] if k else 0)
    assert {"Array", "Bitmap"} <= kinds


@pytest.mark.parametrize("members", [[0], [65_535], [0, 65_535], range(65_536), range(0, 65_536, 2), [*range(9, 5000), 60_000], range(0, 65_536, 77)])
def test_containers_select_their_members(members):
    low = np.array(members, np.uint16)
    kinds = [fillmiddle.container(low), fillmiddle.Array(low), fillmiddle.Bitmap(low)]
    kinds.append(fillmiddle.Runs(low, np.flatnonzero(np.diff(low.astype(np.int64), prepend=-2) != 1)))
    for k in {0, len(low) - 1, len(low) // 2, len(low) // 3}:
        assert {c.select(k) for c in kinds} == {int(low[k])}


def test_cut_texts_as_brute_force(spark, odd, odd_docs):
    rng = random.Random(6)
    rows = [(r[0], r[1]) for r in odd_docs] + [(1000 + i, t) for i, t in enumerate(texts(rng))]
    rows += [(2000 + i, "".join(rng.choices(["<", "P", "S>", "M", ">", " ", "<P", "é"], k=12))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("x"))
    got = fillmiddle.transform(df)
    same(got.collect(), [brute_cut(*r) for r in rows])
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    back = got.select("doc_id", fillmiddle.restored().alias("text")).collect()
    same(back, [(i, t or "") for i, t in rows])


def test_cuts_of_nothing_and_of_a_clashing_id(nothing):
    assert fillmiddle.transform(nothing).count() == 0
    with pytest.raises(ValueError):
        fillmiddle.transform(nothing.withColumnRenamed("doc_id", "output"), "output")


# --- token counts -----------------------------------------------------------


def test_counts_are_those_of_whole_texts(spark, sf_dir, odd, odd_docs):
    rng = random.Random(7)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    odd_texts = ["", " ", "  ", "a ", " a", "a  b   c", "▁a▁ ▁", "\x00 a", "<s> </s> <unk> <0x41>", "ﬁ　Ａ 漢字😀", "\n \n", "a b", "x" * 300_000, " " * 100_000, "1234567 " * 5000]
    odd_texts += ["".join(rng.choices("ab .é▁ \n", k=40)) for _ in range(300)]
    rows = [(r[0], r[1]) for r in odd_docs] + list(enumerate(odd_texts))
    rows += [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    want = []
    for i, t in rows:
        n = len(library.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    same(tokencounts.count_tokens(df, MODEL).collect(), want)
    same(tokencounts.count_tokens(df, MODEL, common=50).collect(), want)  # most are joined


def test_every_distinct_pre_token_is_encoded_once(spark):
    df = spark.createDataFrame([("a b a",), ("b a  c ",), (None,)], "text string").repartition(3)
    same(tokencounts.dictionary(df, MODEL).select("pre_token", "n").collect(), [("a", 3), ("b", 2), (" c", 1), ("", 1)])


def test_counts_of_nothing_and_refused_models(spark, nothing, tmp_path):
    assert tokencounts.count_tokens(nothing, MODEL).count() == 0
    with pytest.raises(ValueError):
        tokencounts.count_tokens(nothing.withColumnRenamed("doc_id", "n_tokens"), MODEL, "n_tokens")
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.pieces[500].piece = "a▁b"
    (tmp_path / "crossing.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        tokencounts.piece_counter(str(tmp_path / "crossing.model"))


def test_extra_columns_are_not_read(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", 0)], DDL).withColumn("N", F.lit(1)).withColumn("pre_token", F.lit(2))
    assert tokencounts.count_tokens(df, MODEL).collect()[0].n_tokens == 2
    assert divergence.audit(df).count() == 0
