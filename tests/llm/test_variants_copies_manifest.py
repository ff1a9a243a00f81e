import os
import random
import sys
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from threadloom.llm import merkle, minhash, spelling  # noqa: E402

LETTERS = "abdeéikloprstÿÀ"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(5)
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(4, 9))) for _ in range(60)]
    for w in list(words):
        for _ in range(4):
            i, c = rng.randrange(len(w)), rng.choice(LETTERS)
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w + c]))
    long = "ab" * 900
    words += [long, long[:700] + "é" + long[700:], long[:-1], "a" * 1200, "a" * 1201]
    texts = [" ".join(rng.choice(words) for _ in range(70)) for _ in range(60)] + [" ".join([w] * k) for k, w in enumerate(words, 2) if k < 40]
    texts += ["klmno " * 3 + "klmnop " * 6 + "klmnopq " * 12 + "klmnopqz " * 30]  # forms lead on
    texts += [f"{long} {long[:700]}é{long[700:]} {long[:-1]}, {'a' * 1200}-{'a' * 1201}"] * 8 + ["×÷×÷× ×÷×÷×", "", "  \n", None, "MÀÉ mÀé Ωabcde1abcde_abcde\U0001f600abcde"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (3, texts[3]), (3, texts[3])]


def test_spelling_variants(spark, vocabulary, none):
    docs = spark.createDataFrame([(*r, "x", 1) for r in vocabulary], "doc_id long, text string, word string, n long").repartition(5)
    want = sorted(brute.spelling(vocabulary), key=str)
    assert rows(spelling.variants(docs)) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] is not None for r in want) and max(len(r[0]) for r in want) > 1000
    assert spelling.variants(none).count() == 0 and spelling.variants(docs.filter("text IS NULL")).count() == 0


def test_neighbourhoods_hold_each_edit_at_one_of_its_ends():
    name = lambda s: int(spelling.reduced(np.array(s, int))[0])
    near = lambda s, step=4096: set(np.concatenate(list(spelling.neighbours(np.array(s, int), step))).tolist())
    for word in ("abcde", "ÿaÿaÿa", "aaaaaaaaa"):
        s = spelling.symbols(word).tolist()
        every = range(spelling.SYMBOLS)
        edits = [s, *(s[:i] + s[i + 1 :] for i in range(len(s))), *(s[:i] + [a] + s[i + k :] for i in range(len(s) + 1) for a in every for k in (0, 1))]
        assert all(name(r) in near(s) or name(s) in near(r) for r in edits) and near(s) == near(s, 2)
        assert near(s) <= {name(r) for r in edits}
        for other in (word[1:], word + "x", "z" + word[1:]):
            assert (spelling.letter_mask(word) ^ spelling.letter_mask(other)).bit_count() <= 2
    assert len(set(spelling.symbols("".join(map(chr, range(97, 123)))).tolist())) > 4


@pytest.mark.parametrize("block", [minhash.BLOCK, 1500])
def test_near_duplicates(monkeypatch, corpus, docs, none, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    assert rows(minhash.near_duplicates(docs)) == sorted(brute.near_duplicates([r[:2] for r in corpus]), key=str)
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [minhash.BLOCK, 2500])
def test_near_duplicates_of_one_original_and_chains(monkeypatch, spark, block):
    """Copies that reach the threshold with their original only, and chains of copies; nothing is all pairs."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = rng.sample(words, 120)
    texts = [" ".join(base)]
    for _ in range(50):
        w = list(base)
        for i in rng.sample(range(120), 3):
            w[i] = rng.choice(words)
        texts.append(" ".join(w))
    chain = rng.choices(words, k=90)
    for i in range(20):
        chain = [*chain[4:], *rng.choices(words, k=4)]
        texts.append(" ".join(chain))
    texts += [" ".join(base[:100] + rng.choices(words, k=20 + i)) for i in range(10)] + ["a b c d e f g", "a b c d e f g h", "a b c d e", "a b c d e f"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert rows(minhash.near_duplicates(frame)) == sorted(brute.near_duplicates(list(enumerate(texts))), key=str)


def test_sketches_fill_and_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    for n, shared in ((1, 1), (7, 6), (40, 30), (400, 380), (2500, 1500)):
        agree = []
        for _ in range(12):
            some = rng.choice(pool, 2 * n - shared, replace=False)
            a, b = minhash.sketches([some[:n], some[n - shared :]])
            assert not (a == minhash.FULL).any()
            agree.append((a == b).mean())
        assert abs(np.mean(agree) - shared / (2 * n - shared)) < 0.05
    few = minhash.sketches([pool[:1], pool[1:3]])
    assert not (few == minhash.FULL).any() and (few[0] >> np.uint64(55)).max() > 100  # late rounds fill one bin each


def test_pairs_at_the_threshold_share_a_band():
    rng = np.random.default_rng(3)
    for n in (7, 40, 400):
        shared = -(-minhash.PERCENT * 2 * n // (100 + minhash.PERCENT))
        some = [rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64) for _ in range(300)]
        keys = minhash.band_keys(minhash.sketches([s[:n] for s in some] + [s[n - shared :] for s in some]))
        assert all(set(a) & set(b) for a, b in zip(keys[:300].tolist(), keys[300:].tolist(), strict=True))


def leaves(corpus):
    rng = random.Random(6)
    out = [(r[0], r[3], r[2], r[4], r[1]) for r in corpus]
    out += [(1000 + i, rng.choice(["é", "", None]), rng.choice(["en"] * 8 + ["", "ü", "z", None]), rng.choice([i, None]), "t" * (i % 5)) for i in range(400)]
    return out + [(7, "s", "alone", 2**63 - 1, ""), *out[:3] * 40]


@pytest.mark.parametrize("page", [merkle.PAGE, 3])
def test_manifest(monkeypatch, spark, corpus, page):
    monkeypatch.setattr(merkle, "PAGE", page)
    data = leaves(corpus)
    docs = spark.createDataFrame([(*r, "x", b"y") for r in data], "doc_id long, source string, lang string, n_chars long, text string, g string, digest binary").repartition(6)
    got, want = rows(merkle.verified_rows(docs)), brute.manifest(data)
    # equal rows are leaves each, and which of them has which proof is not defined: their proofs are compared together
    assert got == sorted(want, key=str)
    assert 0 < sum(r[6] for r in want) < len(want) and sum(not r[6] for r in want) > 20


def test_manifest_of_few_rows(spark, none):
    assert merkle.verified_rows(none.select("doc_id", "source", "lang", "n_chars", "text")).count() == 0
    for some in ([(5, "s", None, 3, "t")], [(5, "s", "en", 3, "t"), (6, "s", "fr", 3, None)]):
        docs = spark.createDataFrame(some, "doc_id long, source string, lang string, n_chars long, text string")
        assert rows(merkle.verified_rows(docs)) == sorted(brute.manifest(some), key=str)


def test_descent_answers_requests_for_some_leaves_only(spark):
    nodes = spark.range(37).select(F.lit("a").alias("g"), F.col("id").alias("i"), F.lit(37).cast("long").alias("n"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"))
    tree = merkle.build(nodes)
    tops = tree.tops.withColumn("path", F.array().cast(merkle.STEP))
    asked = spark.createDataFrame([("a", 3, "x"), ("a", 36, "y"), ("a", 3, "z"), ("a", 37, "beyond"), ("b", 0, "nowhere")], "g string, i long, own string")
    got = merkle.descend(tops, tree.pages, asked).withColumn("root", merkle.fold(F.col("digest"), F.reverse("path"))).collect()
    assert sorted((r.i, r.own) for r in got) == [(3, "x"), (3, "z"), (36, "y")] and {bytes(r.root) for r in got} == {bytes(r.base) for r in got}
    assert len({bytes(r.root) for r in got}) == 1


def test_links_need_a_common_key():
    texts = ["a b c d e f g h", "a b c d e f g h i", "a b c d e f g h"]
    members = [(i, i, keys, t) for i, (t, keys) in enumerate(zip(texts, ([1], [1, 2], [3]), strict=True))]
    assert minhash.links(members, []) == [(1, 0)]
    sets = minhash.word_sets(texts)
    assert [len(np.intersect1d(a, b)) for a, b in combinations(sets, 2)] == [6, 6, 6]
