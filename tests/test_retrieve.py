import os
import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.operators import retrieve

GIVEN = "/root/testdata/sf0.01/embeddings.parquet"


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="the given vectors are not there")
def test_index_of_the_given_vectors_recalls_nine_tenths_of_a_tenth(spark, tmp_path):
    corpus = spark.read.parquet(GIVEN).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = corpus.filter("id % 5 = 0").withColumnRenamed("id", "query_id")
    path = f"file://{tmp_path}/index"
    retrieve.build_index(corpus, path)
    found = retrieve.search_index(queries, path)
    exact = retrieve.top_k(queries, corpus)
    assert retrieve.recall(found, exact) >= 0.9
    n = corpus.count()
    assert found.select("query_id", "compared").distinct().agg(F.avg("compared")).first()[0] < 0.1 * n
    same = found.join(exact.withColumnRenamed("score", "s"), ["query_id", "id"]).filter("abs(s - score) > 1e-6")
    assert same.count() == 0


def test_clusters_need_few_cells_and_all_rows_are_in_one(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in centres[i % 20]]) for i in range(600)] + [(700, [0.0] * 16), (701, None), (702, centres[0]), (703, centres[0])]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = corpus.filter("id < 40 OR id > 699").withColumnRenamed("id", "query_id")
    path = f"file://{tmp_path}/index"
    monkeypatch.setattr(retrieve, "CHUNK", 50)
    index = retrieve.build_index(corpus, path)
    assert sorted(r[0] for r in index.select(F.explode("v.id")).collect()) == sorted(r[0] for r in rows if r[1] is not None)
    probes = retrieve.fewest_probes(queries, corpus, path)
    cells = spark.read.parquet(f"{path}-centres").count()
    assert probes <= cells // 2
    assert retrieve.recall(retrieve.search_index(queries, path, probes=probes), retrieve.top_k(queries, corpus)) >= 0.9
    assert retrieve.search_index(queries.filter("query_id < 0"), path).count() == 0


def test_several_exclusions_leave_k_hits(spark):
    corpus = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(10)], "id long, vector array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.9])], "query_id long, vector array<double>")
    out = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (0, 2), (1, 9)], "query_id long, id long")
    got = retrieve.retrieve(queries, {"kb": corpus.filter("id < 9"), "ticket": corpus.filter("id = 9")}, 5, out).collect()
    assert {q: [r.id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 1)} == {0: [3, 4, 5, 6, 7], 1: [8, 7, 6, 5, 4]}


def test_highlights_are_the_places_of_query_words(spark):
    texts = [("Refund the order", "My ORDER, (no 7): refund?  Refunded order_7 order"), ("the of", "the of it"), ("é1 Ünï", "x é1-ünï É1"), (None, "a b"), ("a", None), ("word", ""), ("  word ", "  word"), ("far", "near " * 3000 + "far far")]
    frame = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, q string, d string")
    for r in frame.select("q", "d", retrieve.highlight(F.col("q"), F.col("d")).alias("h")).collect():
        terms = {w.lower() for w in re.findall(r"\w+", r.q or "")} - set(retrieve.STOP)
        assert [tuple(x) for x in r.h] == [m.span() for m in re.finditer(r"\w+", r.d or "") if m.group().lower() in terms]


def test_top_k_breaks_ties_by_id_and_takes_small_corpora(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.0, 0.0]) for i in range(200)], "id long, vector array<double>")
    asked = spark.createDataFrame([(q, [2.0, 1.0]) for q in range(70)], "query_id long, vector array<double>")
    got = retrieve.top_k(asked, rows, 3).collect()
    assert {(r.query_id, r.rank, r.id) for r in got} == {(q, i + 1, x) for q in range(70) for i, x in enumerate((1, 2, 4))}
    assert retrieve.top_k(asked, rows.filter("id < 2"), 3).count() == 140


def test_registered_queries_have_short_arrow_batches(spark, tmp_path):
    from threadloom.plans import registry

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        spark.range(1).selectExpr("id event_id", "'a' event_type", "timestamp('2024-01-01') ts").write.parquet(f"{tmp_path}/events.parquet")
        registry.queries()["weekly_counts"](spark, str(tmp_path))
        assert spark.conf.get(name) == "4m"
    finally:
        spark.conf.set(name, before)


def test_an_index_of_which_all_is_read_meets_blocks_of_queries_not_copies_of_vectors(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(400)] + [(900, [0.0] * 4), (901, None)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = corpus.withColumnRenamed("id", "query_id")
    path = f"file://{tmp_path}/index"
    for name, value in (("CHUNK", 20), ("BLOCK", 64), ("HELD", 2)):
        monkeypatch.setattr(retrieve, name, value)
    retrieve.build_index(corpus, path)
    found = retrieve.search_index(queries, path, within=retrieve.BITS)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    shape = lambda df: {(r.query_id, r.id, r["rank"], round(r.score, 9)) for r in df.collect()}
    exact = queries.filter("vector IS NOT NULL")
    assert shape(found) == shape(retrieve.top_k(exact, corpus.filter("vector IS NOT NULL")))  # many scores are equal
    assert {r.compared for r in found.select("compared").collect()} == {401}
