from pyspark.sql import functions as F

from threadloom.operators import classify, evaluate
from threadloom.operators import spans as spans_
from threadloom.plans import q_sources, q_spans


def test_json_utterances_carries_whole_texts(spark, tmp_path):
    texts = ["a \"quoted\" line\n\tback\\slash " * 40, "x" * 161, "\u00e9\u4e2d\U0001f600\r\n" * 99, "", "z", None]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = q_sources.json_utterances(spark, str(tmp_path)).groupBy("external_id").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()
    assert {int(r.external_id): (r.k, r.n) for r in got} == {i: (2, None if t is None else len(t)) for i, t in enumerate(texts)}


def test_train_baseline_has_the_whole_vocabulary(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "en", "a text") for i in range(20)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(classify, "train", lambda rows, kind, vocabulary: seen.append(vocabulary) or 1 / 0)
    try:
        q_sources.train_baseline(spark, str(tmp_path))
    except ZeroDivisionError:
        pass
    assert seen == [30_000]


def test_bootstrap_of_the_registered_query(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(30)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    r = q_spans.bootstrap_f1(spark, str(tmp_path)).first()
    assert r.low < r.f1 < r.high


def test_align_spans_shuffles_tokens_once_and_keeps_repeated_ones(spark):
    tokens = [(1, 0, 0, 5, "x"), (1, 1, 5, 9, "y"), (1, 1, 6, 6, "z"), (1, 2, 9, 12, "x"), (1, 2, 9, 12, "x"), (2, 0, 0, 4, "x"), (None, 0, 0, 4, "n"), (1, None, 0, 4, "p"), (1, 4, None, 4, "q")]
    spans = [(1, 4, 10, "B"), (1, 4, 10, "B"), (1, 6, 8, "A"), (2, 4, 9, "A"), (1, 3, 20, None), (None, 0, 9, "A")]
    want = []
    hits = lambda s: [t for t in tokens if None not in (t[0], t[2], t[3], s[0]) and t[0] == s[0] and t[2] < t[3] and t[2] < s[2] and s[1] < t[3]]
    for t in tokens:
        tags = [("B-" if h[1] == min(x[1] for x in hits(s) if x[1] is not None) else "I-") + s[3] for s in spans if s[3] for h in hits(s) if h[:2] == t[:2] and h[1] is not None]
        want.append((*t, min(tags, default="O")))
    got = spans_.align_spans(spark.createDataFrame(tokens, "doc_id long, pos int, start int, end int, more string"), spark.createDataFrame(spans, "doc_id long, start int, end int, label string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got.groupBy("doc_id", "tag").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # tokens and spans, by doc_id
