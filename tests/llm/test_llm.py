import hashlib
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from threadloom.llm import common, components, decontaminate, jaccard_join, language_id, media_columns, ngram_quality, poly_hash, source_mix, suffix_dedup, toxicity, url_rules, warc  # noqa: E402


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_span_hashes_agree_with_bytes():
    raw = np.frombuffer(b"abracadabra" * 5, np.uint8)
    p = poly_hash.prefixes(poly_hash.values(1)[raw])
    spans = [(a, b) for a in range(0, 50, 3) for b in range(a + 1, 55, 4)]
    h = poly_hash.spans(p, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    assert len(set(h.tolist())) == len({raw[a:b].tobytes() for a, b in spans})


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    part = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        part[y] = x
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(6))
    assert {r.node: r.label for r in got.collect()} == {x: root(x) for x in list(part)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_make_no_rounds(spark, monkeypatch):
    edges, kept = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (900, 700)], "a long, b long").repartition(6), []
    monkeypatch.setattr(components, "cut", lambda df, cut=components.cut: kept.append(1) or cut(df))
    want = {(i, 0) for i in range(201)} | {(500, 500), (700, 700), (900, 700)}
    assert {tuple(r) for r in components.components(edges).collect()} == want and len(kept) == 3  # rounds would add to them
    monkeypatch.setattr(components, "FEW", 20)
    assert {tuple(r) for r in components.components(edges).collect()} == want


def test_contamination(spark, corpus, docs, none):
    rng = random.Random(4)
    text = next(t for _, t, *_ in corpus if t and len(t.split()) > 100)
    items = [(1, text.upper()), (2, " ".join(text.split()[20:40])), (3, "BA-de fi!"), (4, ""), (5, None), (6, "ba"), (7, "nowhere to be found"), (8, " ".join(rng.sample(text.split(), 30))), (9, " ".join(text.split()[50:55]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate.contamination(docs, bench)) == sorted(brute.contamination([r[:2] for r in corpus], items), key=str)
    kept = decontaminate.uncontaminated(docs, bench)
    bad = Counter(str(r[0]) for r in brute.contamination([r[:2] for r in corpus], items) if not r[5])
    assert kept.columns == docs.columns and Counter(str(r.doc_id) for r in kept.collect()) == bad
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("most, hashed", [(suffix_dedup.MOST, suffix_dedup.window_hash), (2, suffix_dedup.window_hash), (2, lambda code, values, length: suffix_dedup.window_hash(code, values, length) & 15)])
def test_repeats(corpus, docs, none, most, hashed):
    """most = 2 deals all but rare runs out by window; colliding hashes must not add or lose a match."""
    got = suffix_dedup.remove_repeats(docs, most=most, hashed=hashed).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    want = [(r[0], *x) for r, x in zip(corpus, brute.repeats([r[1] for r in corpus]), strict=True)]
    assert sorted((str(a), *b, bytes(k)) for a, *b, k in got.collect()) == sorted((str(a), *b) for a, *b in want)
    if most == 2:
        assert suffix_dedup.repeat_report(none).count() == 0
        left = suffix_dedup.without_repeats(docs)
        assert left.columns == docs.columns and left.filter("length(trim(text)) = 0 OR text IS NULL OR n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 2])
@pytest.mark.parametrize("length", [51, 8])
def test_repeated_words(corpus, docs, length, most):
    got = suffix_dedup.remove_repeats(docs, length=length, unit="words", most=most).select("row.doc_id", "kept").collect()
    want = brute.repeated_words([r[1] for r in corpus], length)
    assert sorted((str(d), bytes(k).decode()) for d, k in got) == sorted((str(r[0]), t) for r, t in zip(corpus, want, strict=True))


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 2])
def test_bytes_and_passages_in_one_search(corpus, docs, most):
    """What is cut and the passages that are counted beside it are as if each were searched for alone."""
    got = suffix_dedup.remove_repeats(docs, most=most, passage=51).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept", *suffix_dedup.PASSAGES)
    texts = [r[1] for r in corpus]
    want = [(r[0], *x, *y) for r, x, y in zip(corpus, brute.repeats(texts), brute.passages(texts), strict=True)]
    assert sorted((str(a), *b, bytes(k), n, m) for a, *b, k, n, m in got.collect()) == sorted((str(a), *b) for a, *b in want)


def test_report_tells_passages_of_under_400_bytes(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 6))) for _ in range(n))
    short, passage = text(50), text(51)
    texts = [f"{text(40)} {passage} {text(40)}", f"{text(60)}\n{passage}\t{text(5)}", passage.replace(" ", "  "), f"{text(40)} {short} {text(40)}", f"{text(30)} {short}", text(300), None, ""]
    got = suffix_dedup.repeat_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words", "n_passages"]
    assert len(passage) < suffix_dedup.LENGTH
    assert rows(got) == sorted([(i, len(t or ""), 0, 0, hashlib.sha256((t or "").encode()).hexdigest(), 51 * (i < 3), int(i < 3)) for i, t in enumerate(texts)], key=str)


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    values = suffix_dedup.BYTES[np.random.default_rng(1).integers(0, 3, 5000)]
    chosen = lambda found: {w: p for _, p, a, b in zip(*(x.tolist() for x in found), strict=True) for w in range(a, b + 1)}
    whole = chosen(suffix_dedup.anchors(values, 40))
    monkeypatch.setattr(suffix_dedup, "STEP", 137)
    assert chosen(suffix_dedup.anchors(values, 40)) == whole and len(whole) == 5000 - 39


def test_passages_of_over_50_words_go_and_other_text_stays(spark):
    import corpus_pipeline

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = {i: text(rng.randint(20, 300)) for i in range(150)}
    short = text(50)  # shared, and too short
    clean |= {200 + i: f"{text(30)} {short} {text(30)}" for i in range(10)}
    passages = [text(rng.randint(51, 60)) for _ in range(30)]
    marked = {1000 + 10 * k + i: f"{text(40)} {p}\n{text(40)}" for k, p in enumerate(passages) for i in range(2 + k % 4)}
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in (clean | marked).items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_text(spark, frame, "").collect()}
    assert all(got[i] == t for i, t in clean.items())
    assert len(got) == len(clean) + len(marked) and not any(p in got[1000 + 10 * k + i] for k, p in enumerate(passages) for i in range(2 + k % 4))
    assert all(75 <= len(got[i].split()) <= 80 for i in marked)  # words next to a passage may repeat by chance


def test_suffix_sort_orders_suffixes():
    raw = np.frombuffer(b"banana$bandana$cabana$", np.uint8)
    start = np.arange(len(raw))
    end = np.full(len(raw), len(raw))
    order, shared = suffix_dedup.suffix_sort(raw, poly_hash.prefixes(suffix_dedup.BYTES[raw]), np.zeros(len(raw), np.int64), start, end)
    text = raw.tobytes()
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
    for a, b, n in zip(order[:-1], order[1:], shared[1:], strict=True):
        assert n == len(os.path.commonprefix([text[a:], text[b:]]))


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 700])
def test_jaccard_components(monkeypatch, corpus, docs, none, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # small blocks cut pools apart
    assert rows(jaccard_join.jaccard_components(docs)) == sorted(brute.components([r[:2] for r in corpus]), key=str)
    if block == 700:
        assert jaccard_join.jaccard_components(none).count() == 0
        kept = jaccard_join.one_of_each(docs)
        assert kept.columns == docs.columns
        assert Counter((str(r.doc_id), r.text) for r in kept.collect()) == Counter((str(corpus[i][0]), corpus[i][1]) for i in brute.one_of_each([r[:2] for r in corpus]))


def test_one_row_of_each_component_stays(spark):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    data = [(7, prose(1), "a")] * 3 + [(9, prose(1), "a"), (9, prose(2), "a"), (7, prose(3), "a")] + [(None, prose(4), x) for x in "aab"] + [(None, prose(4) + " more", "a"), (None, prose(1), "a")]
    data += [(1, "", "a"), (1, "", "a"), (None, " ", "a"), (None, None, "a")]
    got = jaccard_join.one_of_each(spark.createDataFrame(data, "doc_id long, text string, k1 string").repartition(4)).collect()
    with_words = Counter((r.doc_id, r.text.split()[0][:3]) for r in got if (r.text or "").strip())
    assert with_words == {(7, "w1x"): 1, (9, "w2x"): 1, (7, "w3x"): 1, (None, "w4x"): 1}  # copies without an id go too
    assert len(got) == 4 + 4


def test_links_probe_long_lists():
    rng = np.random.default_rng(0)
    base = np.arange(300)
    sets = [(i, 300, np.sort(np.concatenate([rng.choice(base, 260, replace=False), 1000 + i * 50 + np.arange(40)]))) for i in range(60)]
    want = components_of([(a[0], b[0]) for a in sets for b in sets if a[0] < b[0] and 7 * len(np.intersect1d(a[2], b[2])) >= 1800])
    assert components_of(jaccard_join.links(sets)) == want


def components_of(pairs):
    part = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        part[y] = x
    return {x: root(x) for x in list(part)}


def test_quality_model_and_cut(spark, corpus, docs, none):
    trusted = {i for i in range(0, 100, 2)}
    ids = spark.createDataFrame([(i,) for i in trusted] + [(None,), (2,)], "doc_id long")
    got = ngram_quality.quality_report(docs, ids).collect()
    texts = [r[1] for r in corpus]
    scored = brute.perplexities([t for d, t, *_ in corpus if d in trusted], texts)
    want = sorted((str(r[0]), n, round(s / n, 2) if n else None) for r, (n, s) in zip(corpus, scored, strict=True))
    have = sorted((str(r.doc_id), r.n_symbols, round(float(np.log(r.perplexity)), 2) if r.n_symbols else None) for r in got)
    assert all(a[:2] == b[:2] and (a[2] is b[2] or abs(a[2] - b[2]) < 0.02) for a, b in zip(have, want, strict=True))
    kept = brute.kept_by_quality([r[:3] for r in corpus], trusted)
    assert Counter((str(r.doc_id), r.kept) for r in got) == Counter((str(r[0]), k) for r, k in zip(corpus, kept, strict=True))
    assert ngram_quality.quality_report(none, ids).count() == 0
    assert ngram_quality.quality_report(docs, ids.limit(0)).filter("kept").count() == sum(n > 0 for n, _ in scored)
    noise = docs.select(F.lit(5000).alias("doc_id"), F.lit("#$% $$ &&& *** " * 10).alias("text"), "lang", F.lit(1).alias("kept"))
    assert ngram_quality.keep_fluent(docs.select("doc_id", "text", "lang", F.lit(1).alias("kept")).unionByName(noise.limit(3)), ids).filter("text LIKE '#%'").count() == 0


def test_quality_tells_scripts_beyond_latin_apart(spark):
    rng = random.Random(4)
    data = []
    for k, (lang, first, n) in enumerate((("ru", 0x430, 32), ("el", 0x3B1, 24), ("zh", 0x4E00, 40), ("x", 0x20000, 40))):
        letters = [chr(first + i) for i in range(n)]
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(40)]
        prose = lambda: " ".join(rng.choice(words) for _ in range(120))
        data += [(1000 * k + i, prose(), lang) for i in range(60)]
        data += [(1000 * k + 500 + i, "".join(rng.choice(letters) for _ in range(500)), lang) for i in range(5)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    ids = frame.filter("doc_id % 1000 < 40").select("doc_id")
    got = ngram_quality.quality_report(frame, ids).collect()
    assert {r.doc_id for r in got if not r.kept} == {d for d, *_ in data if d % 1000 >= 500}
    scored = {d: (n, s) for (d, *_), (n, s) in zip(data, brute.perplexities([t for d, t, _ in data if d % 1000 < 40], [t for _, t, _ in data]), strict=True)}
    assert all(r.n_symbols == scored[r.doc_id][0] and abs(np.log(r.perplexity) - scored[r.doc_id][1] / r.n_symbols) < 1e-5 for r in got)


def test_distribution_sums_to_one():
    g = np.unique(np.random.default_rng(2).integers(0, 64**4, 500))
    p = np.exp(ngram_quality.kneser_ney(g, np.arange(1, len(g) + 1)).astype(np.float64)).reshape(-1, 64).sum(axis=1)
    assert np.allclose(p, 1, atol=0.01)


def test_language(spark, docs, none):
    rng = random.Random(2)
    vocab = {"xx": "alba korda mine tuva selo".split(), "yy": "the quick fox jumps thorn".split()}
    made = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(3, 30))), lang) for i in range(160) for lang in [("xx", "yy")[i % 2]]]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    out = language_id.identify(frame, language_id.train(frame)).collect()
    lang = {d: x for d, _, x in made}
    test = [r for r in out if r.held_out]
    assert {r.doc_id for r in test} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) >= 0.95 * len(test)
    swapped = frame.withColumn("lang", F.when(common.held_out(), "xx").otherwise(F.col("lang")))
    again = language_id.identify(frame, language_id.train(swapped)).collect()
    assert sorted(out) == sorted(again)  # labels that are held out teach nothing
    edge = language_id.identify(docs, language_id.train(frame)).collect()
    assert len(edge) == docs.count()
    assert all((r.lang_pred == "und") == (r.score == 0) for r in edge)
    assert language_id.identify(none, language_id.train(none)).count() == 0


def test_url_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.com", "", "block"), ("com", "/fr/", "block"), (None, "/", "block")]
    urls = ["http://x.example.org/es/1", "http://example.org/en/12", "http://notexample.org/es/", "http://EXAMPLE.org/EN/1", "https://b.a.com/x?y", "http://a.com", "http://aa.com/fr/1", "http://com/de/", "ftp://q.com/de", "x", None, "", "http://", "http://org", "http://b c.org/#f", "http://../..", "a://b://c/d", "http://a.com.org/é/"] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("x"))

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :]
        for c in "?#":
            path = path.split(c)[0]
        host = brute.ascii_lower(host)
        best = {}
        for h, p, v in rules:
            if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p):
                best[h, p] = max(v, best.get((h, p), ""))
        top = max(best, key=lambda k: (len(k[0] + k[1]), len(k[0])), default=None)
        return host, path, "".join(top) if top else None, best[top] if top else "allow"

    got = url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert rows(got) == sorted(((i, *judge(u)) for i, u in enumerate(urls)), key=str)
    assert url_rules.judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string")).collect()} == {"allow"}


def test_media_round_trip_and_retries(spark, corpus, docs, none, tmp_path):
    out = media_columns.media_features(docs, f"file://{tmp_path}/m").collect()
    want = []
    for d, t, *_ in corpus:
        raw = (t or "").encode()
        pay = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        want.append((str(d), len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == sorted(want)
    assert len({r.payload_sha256 for r in out}) == len({(r.payload_sha256, r.n_bytes, r.media_sha256, r.feature) for r in out} - {x for x in []}) or len({(r.n_bytes, r.payload_sha256) for r in out}) == len({(r.n_bytes, r.payload_sha256, r.media_sha256, r.feature) for r in out})
    assert media_columns.media_features(none, f"file://{tmp_path}/n").count() == 0
    path = next((tmp_path / "m").glob("*.zip"))
    data = bytearray(path.read_bytes())
    at = data.index(b"IDAT")
    data[at + 20] ^= 255
    path.write_bytes(bytes(data))
    media = media_columns.read_archives(spark, f"file://{tmp_path}/m")
    assert media.filter("error IS NOT NULL").count() == 1 and media.count() == len(corpus)  # the others are not touched
    small = spark.read.format("media_archives").option("rangeBytes", "4096").load(f"file://{tmp_path}/m")
    assert small.count() == len(corpus) and small.rdd.getNumPartitions() > 4


def test_toxicity(spark, docs, none):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(80)]
    made = [(i, " ".join(rng.choice(vocab) for _ in range(40)) + (" you nasty fool" if i % 5 == 0 else "")) for i in range(400)]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score(frame, toxicity.train(frame, labels)).collect()}
    test = [i for i in out if out[i].held_out]
    assert all(out[i].predicted == int(i % 5 == 0) for i in test)
    lying = labels.withColumn("toxic", F.when(common.held_out(), 1).otherwise(F.col("toxic")))
    assert {i: r.score for i, r in out.items()} == {r.doc_id: r.score for r in toxicity.score(frame, toxicity.train(frame, lying)).collect()}
    edge = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_mixture(corpus, docs, none):
    got = source_mix.mix_sources(docs).collect()
    want = [(str(r[0]), t) for r, t in zip(corpus, brute.mixture([(r[0], r[1], r[3]) for r in corpus]), strict=True)]
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted(want)
    assert all(r.taken <= 3 * r.size for r in got)
    assert source_mix.mix_sources(none).count() == 0
    m = source_mix.mixed(docs.withColumn("taken", F.lit(-1)))
    assert m.columns == [*docs.columns, "copies", "taken"] and sum(r.taken for r in m.collect()) == sum(t for _, t in want)


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 50, "<p>b</p>", "<p>a</p>"]
    pages = [(i, f"http://x.org/a b/{i}" if i else None, h) for i, h in enumerate(html)] + [(2, "http://x.org/2", "<p>a</p>"), (None, "http://n", "<p>a</p>"), (None, "http://n", "only")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = warc.archived_pages(frame, f"file://{tmp_path}/w").collect()
    b32 = lambda h: warc.digest((h or "").encode())
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in pages:
        alone = first.get(h or "", p) == p
        want.append((str(p), len((h or "").encode()), b32(h), "response" if alone else "revisit", None if alone else first[h or ""]))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), *r[1:])) for r in got)
    names = {p.name for p in (tmp_path / "w/warc").iterdir() if not p.name.startswith(".")}
    assert names and all(n.endswith(".warc.gz") for n in names)
    versions = set()
    for p in (tmp_path / "w/arc").glob("*.arc.gz"):
        versions.add(next(iter(warc.arc_records(p.read_bytes())))["block"][:1])
    assert versions == {b"1", b"2"}
    assert warc.archived_pages(frame.limit(0), f"file://{tmp_path}/e").count() == 0
    with pytest.raises(ValueError, match="shorter"):
        list(warc.arc_records(warc.packed(b"http://a 0.0.0.0 20240101000000 text/html 99\nshort\n")))


def test_pipeline(spark, corpus, docs, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    plain = [r[:5] for r in corpus] + [(900 + i, "#$% &&& *** $$$ " * 9, "en", "s1", 9) for i in range(3)]
    spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    trusted = {i for i in range(0, 100, 2)}
    spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(1, " ".join(plain[3][1].split()[:30]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = Counter((str(r.doc_id), r.text, r.taken) for r in corpus_pipeline.run(spark, d).collect())

    left = [r for r, k in zip(plain, brute.kept_by_quality([r[:3] for r in plain], trusted), strict=True) if k]
    left = [left[i] for i in brute.one_of_each([r[:2] for r in left])]
    left = [(r[0], t, *r[2:4]) for r, t in zip(left, brute.repeated_words([r[1] for r in left]), strict=True)]
    left = [r for r in left if r[1].strip(" ")]
    left = [r for r, c in zip(left, brute.contamination([r[:2] for r in left], items), strict=True) if not c[5]]
    taken = brute.mixture([(r[0], r[1], r[3]) for r in left])
    assert got == Counter((str(r[0]), r[1], t) for r, t in zip(left, taken, strict=True) if t)
    assert sum(got.values()) < len(plain) - 45 and sum(t == plain[0][1] for _, t, _ in got) == 1


def _dealt(texts):
    import pyarrow as pa

    raw = [t.encode() for t in texts]
    blob = np.array([len(t) for t in raw], np.int64).tobytes() + b"".join(raw)
    return pa.RecordBatch.from_pylist([{"part": 3, "source": 0, "at": 0, "n": len(raw), "size": len(blob), "texts": pa.compress(blob, "zstd", asbytes=True)}], jaccard_join.DEALT)


def _bytes(packs):
    return sum(len(r["low"]) + len(r["high"]) for b in packs for r in b.to_pylist())


def test_packed_shingles_take_as_much_with_many_shards_and_come_back(monkeypatch):
    import pyarrow as pa

    r = random.Random(4)
    texts = [" ".join(str(r.randrange(10**6)) for _ in range(200)) for _ in range(300)]
    texts += [" ".join(texts[i].split()[:100] + texts[i + 1].split()[:50]) for i in range(40)] + [texts[0].replace(" ", "  "), "", " "]
    monkeypatch.setattr(jaccard_join, "BATCH", 20_000)
    few, many = (list(jaccard_join.packer(n)(iter([_dealt(texts)]))) for n in (8, 200))
    assert _bytes(many) < 1.3 * _bytes(few)
    sets = {jaccard_join.digest(s): s for t in texts if len(s := jaccard_join.shingles(t))}
    df = Counter(x for s in sets.values() for x in s.tolist())
    want = {(c, x, n) for c, s in sets.items() for x in s.tolist() if (n := df[x]) > 1}
    for packs in (few, many):
        whole = pa.Table.from_batches(packs).combine_chunks()
        found = [jaccard_join.shared_shingles(whole.filter(pa.compute.equal(whole["shard"], n))).to_pylist() for n in set(whole["shard"].to_pylist())]
        found = [x for rows in found for x in rows]
        about = {}
        for x in found:
            if x["df"] < 0:
                about.setdefault(x["c"], {})[x["df"]] = x["tok"]
        assert {(a[-3], a[-2]): a[-1] for a in about.values()} == {c: len(s) for c, s in sets.items()} and len(about) == len(sets)
        assert {((about[x["c"]][-3], about[x["c"]][-2]), x["tok"] % 2**64, x["df"]) for x in found if x["df"] > 0} == want


def test_texts_of_equal_sets_in_parts_of_their_own_are_one_component(spark):
    prose = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(60)]
    data = [(100 + k, t) for k, t in enumerate(prose)] + [(k, t.replace(" ", "\t").upper()) for k, t in enumerate(prose)] + [(None, prose[0]), (500, None), (501, " ")]
    got = sorted(jaccard_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect(), key=str)
    want = [(100 + k, 26, k) for k in range(60)] + [(k, 26, k) for k in range(60)] + [(None, 26, 0), (500, 0, 500), (501, 0, 501)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
