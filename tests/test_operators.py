import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import stems, text
from threadloom.operators import drift, evaluate, retrieve, sampling, spans, threads, topics, trends
from threadloom.sources import tables


def weekly(spark, series):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame([(t, start + dt.timedelta(weeks=i), n) for t, ns in series.items() for i, n in enumerate(ns) if n], "topic string, week date, count long")


def flagged(spark, series):
    return {(r.topic, str(r.week)) for r in trends.emerging(trends.topic_trends(weekly(spark, series))).collect()}


def test_injected_spike_is_emerging(spark):
    assert flagged(spark, {"a": [5, 5, 5, 5, 5, 40], "b": [100] * 6}) == {("a", "2024-02-05")}


@pytest.mark.parametrize("series", [{"a": [30] * 6, "b": [100] * 6}, {"a": [1, 1, 1, 9], "b": [50] * 4}, {"a": [0, 0, 0, 0, 0, 1], "b": [50] * 6}, {"a": [10, 10, 10, 10, 10, 30], "b": [20, 20, 20, 20, 20, 60]}])
def test_not_emerging(spark, series):
    assert flagged(spark, series) == set()


def test_dense_window_takes_the_earliest_of_equal_runs(spark):
    got = trends.dense_window(trends.weekly_totals(weekly(spark, {"a": [100, 100, 1, 100, 100, 1, 100]}))).orderBy("week").collect()
    assert [str(r.week) for r in got] == ["2024-01-01", "2024-01-08"]


def test_components_keep_singletons_and_absent_parents(spark):
    posts = spark.createDataFrame([("1", None, None), ("2", "1", None), ("3", "99", None), ("4", "99", None), ("5", "5", None), ("6", None, "7, 8"), ("7", "6", None)], "id string, parent_id string, child_ids string")
    got = {r.id: r.root for r in threads.conversations(posts).collect()}
    assert got == {"1": "1", "2": "1", "3": "3", "4": "3", "5": "5", "6": "6", "7": "6"}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components_are_those_of_union_find(spark, edges):
    parent = list(range(26))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = threads.components(spark.range(26), spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.id: r.root for r in got} == {i: root(i) for i in range(26)}


def test_parent_stands_before_child_under_bad_clocks(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    posts = spark.createDataFrame([("r", "a", None, t(5)), ("r", "b", "a", t(1)), ("r", "c", "b", t(9)), ("s", "d", None, None), ("s", "e", "d", t(0))], "root string, id string, parent_id string, sent_at timestamp")
    got = {r.id: r.place for r in threads.order_posts(posts).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 1}


def test_trajectory_ends_with_the_customer(spark):
    m = spark.createDataFrame([(1, 0, "customer", "x"), (1, 1, "agent", "y"), (2, 0, "agent", "z")], "ticket_id long, seq long, author_role string, text string")
    s = spark.createDataFrame([(1, 0, "negative", 0.5), (1, 1, "positive", 0.9), (2, 0, "positive", 0.4)], "ticket_id long, seq long, label string, score double")
    u = spark.createDataFrame([(1, "high"), (2, "low")], "ticket_id long, urgency_label string")
    got = {r.ticket_id: (r.final_customer_label, round(r.resolution_quality, 3)) for r in threads.trajectories(m, s, u).collect()}
    assert got == {1: ("negative", -0.5), 2: ("positive", 0.132)}


def water(shares, cap):
    shares, capped = dict(shares), {}
    while True:
        left = {k: v for k, v in shares.items() if k not in capped}
        total, room = sum(left.values()), 1 - cap * len(capped)
        scaled = {k: v * room / total for k, v in left.items()}
        over = [k for k, v in scaled.items() if v > cap + 1e-12]
        if not over:
            return scaled | capped
        capped |= dict.fromkeys(over, cap)
        if len(capped) == len(shares):
            return capped


@pytest.mark.parametrize("seed", range(3))
def test_capped_shares_are_the_fixed_point(spark, seed):
    rng = random.Random(seed)
    raw = [rng.random() ** 4 + 1e-4 for _ in range(20)]
    shares = {f"b{i}": x / sum(raw) for i, x in enumerate(raw)}
    got = {r.brand: r.target for r in sampling.capped_shares(spark.createDataFrame(list(shares.items()), "brand string, share double"), 0.12).collect()}
    want = water(shares, 0.12)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_split_is_exact_and_repeatable(spark):
    rows = spark.range(200).withColumn("label", F.when(F.col("id") < 40, "x").otherwise("y"))
    a = sampling.stratified_split(rows, "label", "id")
    assert {(r.label, r.split): r["count"] for r in a.groupBy("label", "split").count().collect()} == {("x", "train"): 28, ("x", "val"): 6, ("x", "test"): 6, ("y", "train"): 112, ("y", "val"): 24, ("y", "test"): 24}
    assert sorted(a.collect()) == sorted(sampling.stratified_split(rows.repartition(5), "label", "id").collect())


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("order #12345 shipped yesterday", [("12345", "ORDER_ID"), ("yesterday", "DATE")]),
        ("charged $25.50 for iPhone 12 Pro Max", [("$25.50", "AMOUNT"), ("iPhone 12 Pro Max", "PRODUCT")]),
        ("account number is closed", []),
        ("account ACC-4029 since March 3, 2023.", [("ACC-4029", "ACCOUNT_REF"), ("March 3, 2023", "DATE")]),
        ("", []),
    ],
)
def test_rule_spans(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(spans.rule_spans("t").alias("s")).first()["s"]
    assert [(s["text"], s["label"]) for s in got] == expected
    assert all(text[s["start"] : s["end"]] == s["text"] for s in got)


def test_rendered_offsets_and_violations(spark):
    r = spans.render_templates(spark.range(50), "id")
    for row in r.collect():
        assert all(row.text[s["start"] : s["end"]] == s["text"] for s in row.entities)
    assert spans.violations(r).count() == 0


def test_duplicate_prediction_is_one_hit_and_one_miss(spark):
    schema = "doc_id long, start int, end int, label string"
    g = spark.createDataFrame([(1, 0, 5, "DATE")], schema)
    p = spark.createDataFrame([(1, 0, 5, "DATE"), (1, 0, 5, "DATE")], schema)
    micro = evaluate.span_f1(g, p).filter("label = 'micro'").first()
    assert (micro.tp, micro.fp, micro.fn) == (1, 1, 0)
    part = evaluate.partial_f1(g, spark.createDataFrame([(1, 3, 9, "DATE")], schema)).first()
    assert (part.tp, part.fp, part.fn) == (1, 0, 0)


def test_kappa_of_nothing_and_of_agreement(spark):
    assert evaluate.kappa(spark.createDataFrame([], "a string, b string")).first().kappa == 0.0
    assert evaluate.kappa(spark.createDataFrame([("x", "x"), ("y", "y")], "a string, b string")).first().kappa == 1.0


def test_rouge_of_equal_and_apart(spark):
    rows = spark.createDataFrame([(1, "the cat sat", "the cat sat"), (2, "a b", "c d"), (3, "the cat sat here", "the cat here sat")], "id long, reference string, summary string")
    got = {r.id: (r.rouge1, r.rouge2, round(r.rougeL, 3)) for r in evaluate.rouge(rows).collect()}
    assert got[1] == (1.0, 1.0, 1.0) and got[2] == (0.0, 0.0, 0.0) and got[3] == (1.0, pytest.approx(1 / 3), 0.75)


def test_opposite_centroids_and_missing_label(spark):
    v = lambda x: spark.createDataFrame([(x,)], "embedding array<double>")
    assert drift.centroid_shift(v([1.0, 2.0]), v([-1.0, -2.0])).first().shift == pytest.approx(2.0)
    with pytest.raises(Exception, match="zero centroid"):
        drift.centroid_shift(v([1.0]), v([0.0])).collect()
    n = lambda rows: spark.createDataFrame(rows, "label string, n long")
    assert drift.psi(n([("a", 5), ("b", 5)]), n([("a", 10)])).first().status == "alarm"


def test_gate_passes_a_score_equal_to_its_bar(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    h = spark.createDataFrame([(1, 0.0), (2, -0.1)], "query_id long, score double")
    assert {r.query_id: r.drafts for r in retrieve.confidence_gate(q, h).collect()} == {1: True, 2: False, 3: False}


def test_sinks_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, x string")
    assert tables.insert_absent(rows, f"{tmp_path}/t", ["id"]) == 2
    assert tables.insert_absent(rows, f"{tmp_path}/t", ["id"]) == 0
    p = spark.createDataFrame([("x", 1), ("y", 2)], "task string, n long").select("n", "task")
    for _ in range(2):
        tables.replace_task(p, f"{tmp_path}/p")
        tables.replace_task(p.filter("task = 'x'").withColumn("n", F.lit(9).cast("long")), f"{tmp_path}/p")
    assert {(r.task, r.n) for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {("x", 9), ("y", 2)}


def test_topic_names_and_labels(spark):
    a = spark.createDataFrame([(1, "-1"), (2, "k")], "id long, topic string")
    k = spark.createDataFrame([("k", "w1", 1), ("k", "w2", 2)], "topic string, term string, rank int")
    got = {r.topic: r.label for r in topics.catalog(a, k).collect()}
    assert got == {"-1": "outliers", "k": "w1, w2"}


def test_partial_matches_go_by_gold_span_in_given_order(spark):
    span = "doc_id long, start int, end int, label string, pos int"
    gold = spark.createDataFrame([(1, 0, 20, "A", 0), (1, 0, 5, "A", 1), (2, 0, 4, "A", 0)], span)
    predicted = spark.createDataFrame([(1, 0, 3, "A", 0), (1, 10, 12, "A", 1), (3, 0, 4, "A", 0)], span)
    r = evaluate.partial_f1(gold, predicted).first()
    assert (r.tp, r.fp, r.fn) == (1, 2, 2)


def test_gold_selection_fills_labels_evenly(spark):
    rng = random.Random(5)
    labels = ("A", "B", "C")
    data = [(i, [rng.choice("AAAAAABBCD") for _ in range(rng.randint(0, 3))]) for i in range(400)]
    frame = spark.createDataFrame(data, "id long, labels array<string>").repartition(5)
    spot = {r.id: r.s for r in frame.select("id", text.seeded(F.col("id"), sampling.SEED).alias("s")).collect()}

    def plain(total, per_label):
        seen, free, rank = dict.fromkeys(labels, 0), 0, {}
        for i, has in sorted(data, key=lambda r: (spot[r[0]], r[0])):
            turns = [(1, seen[x], labels.index(x)) for x in labels if x in has and seen[x] < per_label]
            if has:
                rank[i] = min(turns, default=(2, 0, 0))
            else:
                rank[i] = (0 if free < round(total * 0.15) else 3, 0, 0)
                free += 1
            for x in has:
                seen[x] = seen.get(x, 0) + 1
        return set(sorted(rank, key=lambda i: (rank[i], spot[i], i))[:total])

    for total, per_label in ((100, 30), (60, 10), (30, 30), (500, 30)):
        got = sampling.gold_selection(frame, "id", labels, total, per_label, blind=12).collect()
        assert {r.id for r in got} == plain(total, per_label) and sum(r.blind for r in got) == 12
    chosen = {r.id for r in sampling.gold_selection(frame, "id", labels, 200, 30).collect()}
    for x in labels:
        assert sum(has.count(x) for i, has in data if i in chosen) >= min(30, sum(has.count(x) for _, has in data))
    assert sum(not has for i, has in data if i in chosen) >= 30
    assert sampling.gold_selection(frame.limit(0), "id", labels).count() == 0


def test_posts_of_random_threads_stand_as_taken_one_by_one(spark):
    rng = random.Random(3)
    data = []
    for root in range(40):
        n = rng.randint(1, 14)
        for i in range(n):
            up = rng.choice([None, rng.randrange(n), rng.randrange(n)]) if root % 4 == 0 else (rng.randrange(i) if i else None)
            at = None if rng.random() < 0.1 else dt.datetime(2024, 1, 1, 0, rng.randint(0, 9))
            data.append((root, f"{root}-{i:02}", None if up is None else f"{root}-{up:02}", at))
    data += [(99, f"c{i:03}", f"c{i - 1:03}" if i else None, dt.datetime(2024, 1, 2) - dt.timedelta(minutes=i)) for i in range(100)]
    got = {(r.root, r.id): r.place for r in threads.order_posts(spark.createDataFrame(data, "root long, id string, parent_id string, sent_at timestamp")).collect()}
    for root in {r[0] for r in data}:
        posts = {r[1]: r for r in data if r[0] == root}
        key = {i: (r[3] is not None, r[3] or dt.datetime(1970, 1, 1), i) for i, r in posts.items()}
        done = []
        while ready := [i for i, r in posts.items() if i not in done and (r[2] not in posts or r[2] == i or r[2] in done)]:
            done.append(min(ready, key=key.get))
        done += sorted((i for i in posts if i not in done), key=key.get)
        assert [i for i in sorted(posts, key=lambda i: got[root, i])] == done


def test_sums_before_in_blocks(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), m, w, rng.choice([None, 1, 5])) for m in (*range(1, 6), *range(1020, 1030), 5000) for w in range(3) for _ in "x"]
    frame = spark.createDataFrame(data, "g string, m long, w int, v int")
    got = {(r.m, r.w): r._sum for r in sampling.sum_before(frame, "v", "g", "m", "w").collect()}
    assert got == {(m, w): sum(v or 0 for h, n, x, v in data if h == g and (n, x) < (m, w)) for g, m, w, _ in data}


def test_bootstrap_interval_is_that_of_plain_resampling(spark):
    rng = np.random.default_rng(1)
    gold = [(int(i), int(s) * 10, int(s) * 10 + 5, "A") for i in range(60) for s in range(rng.integers(0, 5))]
    guess = [(i, a, b + (1 if rng.random() < 0.3 else 0), x) for i, a, b, x in gold if rng.random() < 0.8]
    span = "doc_id long, start int, end int, label string"
    r = evaluate.bootstrap_f1(spark.createDataFrame(gold, span), spark.createDataFrame(guess, span), spark.range(60).toDF("doc_id")).first()
    g, p = set(gold), set(guess)
    counts = np.array([[sum(x[0] == i for x in g & p), sum(x[0] == i for x in p - g), sum(x[0] == i for x in g - p)] for i in range(60)])
    f1 = lambda c: 2 * c[0] / (2 * c[0] + c[1] + c[2])
    drawn = sorted(f1(counts[rng.integers(0, 60, 60)].sum(0)) for _ in range(20_000))
    assert r.f1 == pytest.approx(f1(counts.sum(0))) and r.low == pytest.approx(drawn[500], abs=0.015) and r.high == pytest.approx(drawn[19_500], abs=0.015)
    none = evaluate.bootstrap_f1(spark.createDataFrame([], span), spark.createDataFrame([], span), spark.range(0).toDF("doc_id")).first()
    assert tuple(none) == (0.0, 0.0, 0.0)


STEMS = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi relational relat conditional condit digitizer digit vietnamization vietnam operator oper decisiveness decis sensibiliti sensibl triplicate triplic formalize formal electrical electr goodness good revival reviv adjustment adjust adoption adopt homologous homolog probate probat rate rate cease ceas controll control roll roll".split()


def test_stems_of_the_published_examples():
    assert [stems.stem(w) for w in STEMS[::2]] == STEMS[1::2]


@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcde"), max_size=9))
def test_common_length_is_that_of_the_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert stems.common_length(a, b) == table[-1][-1]


def test_rouge_counts_repeats_and_stems(spark):
    rows = spark.createDataFrame([(1, "Cats were running, running!", "the cat runs"), (2, None, "x"), (3, "", ""), (4, "a a b", "a b b")], "id long, reference string, summary string")
    got = {r.id: (r.rouge1, r.rouge2, r.rougeL) for r in evaluate.rouge(rows).collect()}
    assert got[1] == (pytest.approx(4 / 7), 0.0, pytest.approx(4 / 7)) and got[2] == got[3] == (0.0, 0.0, 0.0)
    assert got[4] == (pytest.approx(2 / 3), 0.5, pytest.approx(2 / 3))


def test_week_windows_refuse_an_empty_side(spark):
    rows = spark.sql("SELECT timestamp '2024-01-03 10:00:00' AS t UNION ALL SELECT timestamp '2024-01-16 00:00:00'")
    reference, live = drift.week_windows(rows, "t", "2024-01-01", ("2024-01-08", "2024-01-15"))
    assert reference.count() == live.count() == 1
    with pytest.raises(ValueError, match="live"):
        drift.week_windows(rows, "t", "2024-01-01", ("2024-01-08",))


def test_spans_move_with_splice_and_substitution(spark):
    at = [(3, 7, "DATE", "soon", 1.0)]
    kind = "id int, shell string, text string, entities array<struct<start:int,end:int,label:string,text:string,score:double>>"
    data = [(i, shell, "ok soon", at) for i in range(3) for shell in ("One.  Two! Three", "no end", "\u00e9. \U0001f600? x")]
    frame = spark.createDataFrame(data, kind)
    new, moved = spans.spliced(F.col("shell"), F.col("text"), F.col("entities"), F.col("id"))
    got = {(r.id, r.shell): (r.n, r.m) for r in frame.select("id", "shell", new.alias("n"), moved.alias("m")).collect()}
    assert got[0, "One.  Two! Three"][0] == "One. ok soon. Two! Three" and got[1, "One.  Two! Three"][0] == "One.  Two! ok soon. Three"
    assert all((n is None) == (shell == "no end") for (_, shell), (n, _) in got.items())
    assert all(n[s.start : s.end] == s.text == "soon" for n, m in got.values() if n for s in m)
    new, one = spans.substituted(F.col("text"), F.col("entities")[0], F.lit("\u00e9t\u00e9 2024"))
    r = frame.select(new.alias("n"), one.alias("m")).first()
    assert r.n == "ok \u00e9t\u00e9 2024" and r.n[r.m[0].start : r.m[0].end] == r.m[0].text


def test_proposals_unite_two_annotators(spark):
    kind = "array<struct<start:int,end:int,label:string,text:string,score:double>>"
    frame = spark.createDataFrame([([(0, 4, "DATE", "x", 1.0)], [(2, 9, "MONEY", "y", 0.5), (10, 12, "WHO", "z", 0.5), (0, 4, "WHEN", "x", 0.2)])], f"a {kind}, b {kind}")
    got = frame.select(spans.proposals(F.col("a"), F.col("b"), {"MONEY": "AMOUNT", "WHEN": "DATE"}).alias("p")).first().p
    assert [(s.start, s.end, s.label) for s in got] == [(2, 9, "AMOUNT")]


def test_urgency_agreement_leaves_out_what_has_no_partner(spark):
    m = spark.createDataFrame([(1, 0, "my lawyer will call"), (2, 0, "thanks"), (3, 0, "again")], "ticket_id long, seq int, text string")
    seeds = spark.createDataFrame([(1, 0, "high"), (2, 0, "low"), (3, 0, None), (9, 0, "low")], "ticket_id long, seq int, label string")
    r = evaluate.urgency_agreement(m, seeds).first()
    assert (r.kappa, r.n) == (1.0, 2)


def test_places_are_exact_in_each_group(spark):
    frame = spark.createDataFrame([(i, "xy"[i % 2] if i % 5 else None) for i in range(500)], "id long, g string").repartition(7)
    for by in ((), ("g",)):
        got = sampling.placed(frame, "id", 3, *by).collect()
        groups = {}
        for r in got:
            groups.setdefault(r.g if by else "", []).append((r._p, r._all))
        assert sum(map(len, groups.values())) == 500 and all(sorted(v) == [(i + 1, len(v)) for i in range(len(v))] for v in groups.values())


def test_top_k_meets_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK", 7)
    monkeypatch.setattr(retrieve, "CHUNK", 11)
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4)]
    corpus = spark.createDataFrame(vectors, "id long, vector array<double>")
    got = retrieve.top_k(corpus.filter("id < 20").withColumnRenamed("id", "query_id"), corpus, 3).collect()

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / max(1e-30, math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)))

    want = {(q, r): i for q, v in vectors[:20] for r, (_, i) in enumerate(sorted((-round(cosine(v, w), 9), i) for i, w in vectors)[:3], 1)}
    assert {(r.query_id, r.rank): r.id for r in got} == want


def test_approximate_search_recalls_nine_tenths(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    vectors = [(i, [x + rng.gauss(0, 0.3) for x in centres[i % 20]]) for i in range(300)]
    corpus = spark.createDataFrame(vectors, "id long, vector array<double>")
    queries = corpus.filter("id < 30").withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in retrieve.top_k(queries, corpus).collect()}
    found = {(r.query_id, r.id) for r in retrieve.approximate_top_k(queries, corpus).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
