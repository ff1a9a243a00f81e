import math
import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.functions import languages
from threadloom.functions import text as T
from threadloom.functions.encoding import repair
from threadloom.operators import retrieve as M
from threadloom.sources import versions

DATA = "/root/testdata/sf0.01"


def plain_trigrams(text):
    s = " " + re.sub(r"[^\W\d_]+|.", lambda m: m.group(0) if m.group(0).isalpha() else " ", text or "", flags=re.S)
    s = " " + " ".join(s.lower().split()) + " "
    return [s[i : i + 3] for i in range(len(s) - 2)]


def test_languages_against_plain_loops(spark):
    learned = [("en", "the cat sat on the mat and this that with"), ("es", "el gato está en la casa de la niña"), ("de", "der hund und die katze über das haus"), ("en", "the cat sat"), ("xx", "zzz zzz"), (None, "the"), ("fr", None)]
    asked = [(1, "the hat"), (2, "la niña de"), (3, "über und"), (4, ""), (5, None), (6, "12 !"), (7, "qqqqq"), (8, "der"), (8, "der hund"), (9, "THE " * 20_000)]
    counts = defaultdict(Counter)
    for lang, text in learned:
        if lang in languages.CODES:
            counts[lang].update(plain_trigrams(text))
    counts.pop("fr", None)
    known = {g for c in counts.values() for g, _ in sorted(c.items(), key=lambda p: (-p[1], p[0]))[:20]}
    every = {g for c in counts.values() for g in c}
    want, sums = {}, defaultdict(Counter)
    for ident, text in asked:
        want[ident] = (None, 0.0)
        for g in plain_trigrams(text):
            for lang, c in counts.items():
                if g in known:
                    sums[ident][lang] += math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * len(every)))
    for ident, s in sums.items():
        top = max(s.values())
        want[ident] = (min(x for x in s if s[x] == top), 1 / sum(math.exp(v - top) for v in s.values()))
    profiles = languages.language_profiles(spark.createDataFrame(learned, "lang string, text string"), 20)
    got = {r.id: (r.lang, r.confidence) for r in languages.detected(spark.createDataFrame(asked, "id int, text string"), profiles).collect()}
    assert got.keys() == want.keys()
    for ident, (lang, confidence) in want.items():
        assert got[ident][0] == lang and got[ident][1] == pytest.approx(confidence, abs=1e-3), ident


def test_languages_of_an_empty_table(spark):
    none = spark.createDataFrame([], "lang string, text string")
    profiles = languages.language_profiles(none)
    assert profiles.count() == 0
    got = languages.detected(spark.createDataFrame([(1, "the cat")], "id int, text string"), profiles).first()
    assert (got.lang, got.confidence) == (None, 0.0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("lang IS NOT NULL").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    found = languages.detected(docs.filter("held_out"), languages.language_profiles(docs.filter("NOT held_out")), "doc_id")
    right, n = found.withColumnRenamed("lang", "found").join(docs, "doc_id").agg(F.sum((F.col("found") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 200 and right / n >= 0.95


@pytest.mark.parametrize(
    ("given", "meant"),
    [
        ("cafÃ© olÃ©", "café olé"), ("donâ€™t", "don’t"), ("donâ\x80\x99t", "don’t"), ("ðŸ˜€", "😀"),
        ("ÃƒÂ©tÃƒÂ©", "été"), ("Ã¢Â\x80Â\x99x", "’x"), ("ÃƒÆ’Ã‚Â©", "é"),  # twice and three times over
        ("café 中 Ã©", "café 中 é"), ("Ã© � Ã", "é � Ã"),  # one bad character stops nothing
        ("Ð¿Ñ€Ð¸Ð²ÐµÑ‚", "привет"), ("РїСЂРёРІРµС‚", "привет"), ("æ—¥æœ¬èªž", "日本語"), ("caf√© don‚Äôt", "café don’t"), ("dÄ±Å¡a", "dıša"),
        ("café…”", "café…”"), ("GROß“", "GROß“"), ("СІРІЙ", "СІРІЙ"), ("√π", "√π"), ("日本", "日本"), ("naïve", "naïve"), ("plain", "plain"), ("", ""),
    ],
)
def test_repair(given, meant):
    assert repair(given) == meant


def test_repair_of_whole_alphabets_and_long_texts(spark):
    good = "Füße, ação, čaj, привет, 日本語, “quoted” — naïve …"
    for codec in ("cp1252", "latin-1"):
        bad = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in "ÀÉîöß €".encode())
        assert repair(bad) == "ÀÉîöß €"
    assert repair(good) == good and repair(good * 20_000) == good * 20_000
    got = spark.createDataFrame([("Ã©&amp;" * 10_000,), (None,)], "t string").select(T.repaired("t").alias("t")).collect()
    assert [r.t for r in got] == ["é&" * 10_000, None]


def test_upserts_repeat_and_survive_a_failed_write(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "k int, l string, v int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    read = lambda: sorted((tuple(r) for r in versions.current(spark, path, rows()).collect()), key=repr)
    assert read() == []
    versions.upsert(rows((1, "a", 1), (2, "b", 2), (None, "c", 3), (1, "a", 0)), path, ["k", "l"])
    first = sorted([(1, "a", 1), (2, "b", 2), (None, "c", 3)], key=repr)
    assert read() == first
    with pytest.raises(Exception, match="lost"):
        versions.publish(rows((9, "z", 9)).withColumn("v", F.when(F.rand() >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))), path)
    assert read() == first
    for _ in range(2):
        versions.upsert(rows((None, "c", 4), (5, None, 5)), path, ["k", "l"])
        assert read() == sorted([(1, "a", 1), (2, "b", 2), (None, "c", 4), (5, None, 5)], key=repr)
    numbers = versions.versions(spark, path)
    assert [f for _, f in numbers] == [True, False, True, True] and [n for n, _ in numbers] == [1, 2, 3, 4]


def test_tickets_are_replaced_and_splits_read_alone(spark, tmp_path):
    path, schema = f"file://{tmp_path}/p", "task string, ticket_id int, label string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    versions.publish(rows(("a", 1, "x"), ("a", 1, "y"), ("a", 2, "x"), ("b", 1, "x"), (None, 1, "x")), path)
    for _ in range(2):
        versions.replace_for_tickets(rows(("a", 1, "z"), (None, 1, "n"), (None, 1, "n")), path)
    got = sorted((tuple(r) for r in versions.current(spark, path, rows()).collect()), key=repr)
    assert got == sorted([("a", 1, "z"), ("a", 2, "x"), ("b", 1, "x"), (None, 1, "n"), (None, 1, "n")], key=repr)
    parts = spark.createDataFrame([(1, "train", "a,b\n"), (2, "val", None), (3, "train", "")], "id int, split string, text string")
    versions.write_splits(parts, f"{path}s")
    one = versions.read_split(spark, f"{path}s", parts, "train")
    assert sorted((r.id, r.text) for r in one.collect()) == [(1, "a,b\n"), (3, "")] and one.columns == parts.columns
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().toString()


def test_bm25_against_plain_loops(spark):
    texts = [(1, "refund not paid refund"), (2, "The invoice was paid"), (3, None), (4, ""), (5, "refund refund refund " + "x " * 50), (6, "login")]
    queries = [(10, "refund paid?"), (11, "the of"), (12, None), (13, "login login refund")]
    pairs = [(q, d) for q, _ in queries for d, _ in texts] + [(10, 99)]
    words = {d: [w for w in re.findall(r"\w+", (t or "").lower()) if w not in M.STOP] for d, t in texts}
    df, mean = Counter(w for ws in words.values() for w in set(ws)), sum(map(len, words.values())) / len(texts)

    def score(q, d):
        ws, total = words.get(d, []), 0.0
        for w in {w for w in re.findall(r"\w+", (dict(queries)[q] or "").lower()) if w not in M.STOP}:
            tf = ws.count(w)
            total += math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        return total

    got = M.bm25(spark.createDataFrame(pairs, "query_id int, id int"), spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(texts, "id int, text string")).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert r.bm25 == pytest.approx(score(r.query_id, r.id))
