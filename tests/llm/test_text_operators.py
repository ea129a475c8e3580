import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import decontamination, licenses, packing, simhash, substrings
from hushframe.llm.components import components
from hushframe.llm.hashing import WordHashes, grams, greatest, least
from tests.llm import brute


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


# --- hashes -----------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 2, 3, 5, 10, 35])
def test_grams_are_equal_where_words_are(k):
    words = [b"%d" % (i % 7) for i in range(60)]
    h = grams(WordHashes().of(words), k)
    spans = [tuple(words[i : i + k]) for i in range(60 - k + 1)]
    assert len(h) == len(spans)
    assert len(set(h.tolist())) == len(set(spans))
    assert all((h[i] == h[j]) == (spans[i] == spans[j]) for i in range(len(h)) for j in range(i))


def test_sliding_extremes():
    h = np.random.default_rng(1).integers(0, 100, 50).astype(np.uint64)
    for w in (1, 2, 6, 26):
        assert least(h, w).tolist() == [min(h[i : i + w]) for i in range(51 - w)]
        assert greatest(h, w).tolist() == [max(h[i : i + w]) for i in range(51 - w)]
    assert len(least(h[:3], 6)) == 0


# --- near duplicates --------------------------------------------------------


def test_near_duplicates_as_brute_force(odd, odd_docs):
    got = simhash.near_duplicates(odd).collect()
    same(got, brute.near_duplicates([r[:2] for r in odd_docs]))


def test_links_connect_as_all_pairs_do():
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    near = {centre}
    while len(near) < 400:
        near.add(rng.choice(sorted(near)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    members = np.array(sorted(near | {rng.getrandbits(64) for _ in range(200)}), np.uint64)
    found = list(simhash.forest(members))
    assert len(found) < len(members)
    assert all((a ^ b).bit_count() <= 3 for a, b in found)

    def groups(pairs):
        root = {int(m): int(m) for m in members}

        def of(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[of(a)] = of(b)
        return len({of(int(m)) for m in members})

    every = [(int(a), int(b)) for a in members for b in members if a < b and (int(a) ^ int(b)).bit_count() <= 3]
    assert groups(found) == groups(every)


def test_long_lists_are_split_without_loss(spark, monkeypatch):
    """With lists of four, triples are continued to five bytes and cut to cells."""
    monkeypatch.setattr(simhash, "LIST", 4)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(64)) for _ in range(120)}
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    roots = dict(components(links).collect())
    want = {}
    for p, q in zip(prints, signed):
        want[q] = p
    group = {q: q for q in signed}
    changed = True
    while changed:
        changed = False
        for q in signed:
            for r in signed:
                if (want[q] ^ want[r]).bit_count() <= 3 and group[r] < group[q]:
                    group[q], changed = group[r], True
    assert {q: roots.get(q, q) for q in signed} == group


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(900, 1000)] + [(5000, 5000)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(41)} | {i: 900 for i in range(900, 1001)}
    assert got == want


def test_keep_one_keeps_a_document_of_each_group(odd, odd_docs, nothing):
    kept = simhash.keep_one(odd.withColumn("component_id", F.lit("own")))
    assert kept.columns == [*odd.columns, "component_id"]
    component = {}
    for i, _, c in brute.near_duplicates([r[:2] for r in odd_docs]):
        component.setdefault(i, set()).add(c)
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) == {i for i, c in component.items() if i in c}
    assert ids.count(100) == 0  # stands in the group of document 6
    assert simhash.keep_one(nothing).collect() == []


# --- repeated substrings ----------------------------------------------------


def test_repeats_as_brute_force(odd, odd_docs):
    got = substrings.remove_repeats(odd).collect()
    rows = [(r["doc_id"], r["n_words"], r["n_removed"], " ".join(brute.spaced(r["text"]))) for r in got]
    same(rows, brute.repeats([r[:2] for r in odd_docs]))
    assert [r["text"] for r in got if r["doc_id"] == 0] == [None]
    for r in got:
        assert sum(f["end"] - f["begin"] for f in r["factors"]) == r["n_removed"]


def test_repeats_of_exactly_a_window(spark):
    rng = random.Random(4)
    w = [f"v{i}" for i in range(400)]
    rng.shuffle(w)
    shared, short = w[:35], w[35:69]
    rows = [
        (1, " ".join(w[100:140] + shared + w[140:150])), (2, " ".join(w[150:153] + shared)),
        (3, " ".join(short + w[160:200])), (4, " ".join(w[200:240] + short)), (5, " ".join(["z"] * 36)),
        (6, " ".join(["y"] * 35)),
    ]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {1: 35, 2: 35, 3: 0, 4: 0, 5: 36, 6: 0}


def test_cut_repeats_keeps_clashing_columns(odd, odd_docs, nothing):
    extra = odd.withColumn("n_words", F.lit("mine")).withColumn("starts", F.lit(7)).withColumn("_doc", F.lit(8))
    got = substrings.cut_repeats(extra, length_col="n_chars")
    assert got.columns == extra.columns and got.count() == len(odd_docs)
    for r in got.collect():
        assert (r["n_words"], r["starts"], r["_doc"]) == ("mine", 7, 8)
    assert {r["n_chars"] for r in got.where("doc_id = 12").collect()} == {1}
    kept = substrings.remove_repeats(extra)
    assert "n_words_input" in kept.columns
    assert substrings.remove_repeats(nothing).collect() == []


def test_white_space_of_kept_text_stays():
    gone = np.array([False, True, True, False, False])
    assert substrings.cut(" a\nb  c\td \n e ", gone) == "a\nd \n e"


# --- decontamination --------------------------------------------------------


@pytest.fixture(scope="module")
def items(odd_docs):
    text = odd_docs[10][1]
    w = text.split()
    return [
        (2, " ".join(w[5:25]).upper()), (10, " , ".join(w[15:25])), (3, "one"), (4, ""), (5, None), (6, "two-WORDS!"),
        (7, "aa bb aa bb aa bb aa bb aa bb aa"), (None, " ".join(w[60:75])), (8, "not in any document of these at all you see"),
        (2, "é Ünï 漢字"),
    ]


def test_contamination_as_brute_force(spark, odd, odd_docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(odd, bench).select("doc_id", "n_words", "n_hit", "items", "contaminated", "n_items").collect()
    want = brute.contamination([r[:2] for r in odd_docs], items)
    same([r[:5] for r in got], want)
    assert all(r["n_items"] == len(r["items"]) for r in got)
    clean = decontamination.clean(odd.withColumn("doc", F.lit(1)), bench)
    assert clean.columns == [*odd.columns, "doc"]
    same([r[:2] for r in clean.collect()], [r[:2] for r, w in zip(odd_docs, want) if not w[4]])


def test_contamination_of_empty_tables(spark, odd, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in decontamination.contamination(odd, none).collect()} == {False}
    assert decontamination.clean(odd, none).count() == odd.count()
    one = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert decontamination.contamination(nothing, one).collect() == []


# --- licences ---------------------------------------------------------------


def test_licences(spark, odd, odd_docs, nothing):
    texts = [
        "All rights reserved. (c) All rights  RESERVED", "this work: CC-BY 4.0, cc by",
        "x y This work is licensed under the GNU General Public License, version 3.", "licensed under the gnu general public license version 2",
        "Released under the MIT License. and Licensed under the Apache License, Version 2.0.",
        "licensed under the new apache license version 2 0", "cc", "by cc", "all rights", "general public",
        "you may not use this file ever except in compliance with the license",
        "redistribution and use in source", "Licensed under CC BY-NC 4.0.", None, "",
    ]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(0, texts[0], None, None, None)]
    got = licenses.scan(spark.createDataFrame(rows, odd.schema).union(odd)).collect()
    want = [(r[0], *brute.phrases(r[1], licenses.PHRASES)) for r in [*rows, *odd_docs]]
    same([tuple(r)[:6] for r in got], want)
    found = {}
    for r in got[:]:
        if r["labels"]:
            found.setdefault(r["doc_id"], (r["labels"], r["score"]))
    labels = {i: x for i, (x, _) in found.items()}
    assert labels[0] == ["reserved"]
    assert labels[1] == ["cc-by"]
    assert labels[2] == ["gpl", "gpl-3.0"]
    assert labels[3] == ["gpl", "gpl-2.0"]
    assert labels[4] == ["apache-2.0", "mit"]
    assert labels[10] == ["apache-2.0"]  # one word more: two neighbouring diagonals
    assert labels[12] == ["cc-by", "cc-by-nc-4.0"]
    assert 11 not in labels and 8 not in labels and 9 not in labels
    assert all(0 <= r["score"] <= 1 for r in got)
    assert licenses.scan(nothing).collect() == []


# --- packing ----------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_those_of_the_tokenizer_file(spark, sf_dir, odd_docs, tokenizer_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path)
    plain.encode_special_tokens = True
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += [r[1] or "" for r in odd_docs] + ["<|endoftext|>   \r\n\t 'S it's 12345 \x00 \U0001f600 "]
    encode = packing.tokenizer(tokenizer_path)
    for text, e in zip(texts, plain.encode_batch(texts, add_special_tokens=False)):
        assert encode(text).tolist() == e.ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" + " " * 2_000_000 + "b"], ids=["spaces", "lines", "between"])
def test_long_white_space_is_encoded(tokenizer_path, text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(tokenizer_path).encode(text, add_special_tokens=False).ids
    assert packing.tokenizer(tokenizer_path)(text).tolist() == want


def test_added_tokens_are_packed_as_the_file_gives_them(spark, tokenizer_path):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(tokenizer_path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n<|endoftext|", "none", "é<|endoftext|> " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = {}
    for r in packing.pack(docs, tokenizer_path).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    for i, text in enumerate(texts):
        want = [*loaded.encode(text, add_special_tokens=False).ids, packing.END]
        assert np.frombuffer(b"".join(p[1] for p in sorted(pieces[i])), "<u4").tolist() == want
        assert {p[2] for p in pieces[i]} == {len(want)}


def test_divide_is_near_equal():
    rng = random.Random(6)
    sizes = [rng.randrange(1, 300) for _ in range(900)]
    chosen, sums = packing.divide(sizes, 50)
    assert sums.tolist() == [sum(s for s, c in zip(sizes, chosen) if c == k) for k in range(50)]
    assert sums.max() - sums.min() <= 5
    assert packing.divide([7, 7, 7], 1)[1].tolist() == [21]
    assert sorted(packing.divide([5, 5], 4)[1].tolist()) == [0, 0, 5, 5]
    # Three pieces of 60 need three windows of 100, not two.
    assert len(set(packing.windows([60, 60, 60], 100).tolist())) == 3


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_make_up_the_documents(odd, odd_docs, tokenizer_path, capacity):
    encode = packing.tokenizer(tokenizer_path)
    rows = packing.pack(odd, tokenizer_path, capacity=capacity).collect()
    sequences = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert total / (len(sequences) * capacity) > 0.9
    want = {}
    for i, text, *_ in odd_docs:
        want.setdefault(i, []).append(encode(text or "").tolist() + [packing.END])
    for i, documents in want.items():
        pieces = sorted((r["doc_tokens"], r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == i)
        assert sum(len(p[2]) // 4 for p in pieces) == sum(map(len, documents))
        if len(documents) == 1:
            got = b"".join(p[2] for p in pieces)
            assert np.frombuffer(got, "<u4").tolist() == documents[0]
            assert {p[0] for p in pieces} == {len(documents[0])}


def test_packing_nothing(nothing, tokenizer_path):
    assert packing.pack(nothing, tokenizer_path).collect() == []


def test_digest_of_kept_words_is_over_words(spark, sf_dir):
    from hushframe.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute.repeats(docs)]
    same(QUERIES["op2_substrings"](spark, sf_dir).collect(), want)
