import pytest

from threadloom.plans import q_sampling, q_text

duckdb = pytest.importorskip("duckdb")


def both(spark, folder, query, sql, **tables):
    """Rows of a query and of its SQL over tables, sorted."""
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name, (rows, schema) in tables.items():
        path = f"{folder}/{name}.parquet"
        spark.createDataFrame(rows, schema).write.parquet(path)
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    columns = [d[0] for d in db.execute(sql).description]
    want = sorted(db.execute(sql).fetchall(), key=str)
    return sorted((tuple(r) for r in query(spark, str(folder)).select(*columns).collect()), key=str), want


ODD = [
    "see https://a.b/c?d. Then (www.x.org/y)!", "http\u017f://q\x0bz", "@Jos\u00e9 @" + "a" * 16, "555-123-4567 555-123-4567 (555) 123-4567\n", "x\u00b2a@b.com\u00e9@c.de",
    "e\u0301On Monday Bob wrote: x", "\u00b2On Monday wrote:", "done\nThan\u212as,\nAnn\n", "ok\nBest\nAnn\u2028", "ok\u0085 Sent from my phone\u0085", "a \x0b", "ok ^AB\x0b", "\n\nThanks\n", "", None,
]


def test_mask_entities_as_its_sql(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)]
    got, want = both(spark, tmp_path, q_text.mask_entities, q_text.QUERIES["mask_entities"][1], documents=(rows, "doc_id long, text string"), pages=(rows, "page_id long, html string"))
    assert got == want


def test_strip_signatures_as_its_sql(spark, tmp_path):
    rows = [(4 * i + k, t) for i, t in enumerate(ODD) for k in range(4)]
    got, want = both(spark, tmp_path, q_text.strip_signatures, q_text.QUERIES["strip_signatures"][1], documents=(rows, "doc_id long, text string"))
    assert got == want


def test_drift_by_week_without_live_vectors_as_its_sql(spark, tmp_path):
    events = [(i, 2 * i, "click" if i % 3 else "view", f"2024-01-{2 + 7 * (i // 20):02d}") for i in range(40)]
    rows = spark.createDataFrame(events, "event_id long, user_id long, event_type string, t string").selectExpr("event_id", "user_id", "event_type", "timestamp(t) ts").collect()
    vectors = [(0, [1.0, 2.0])]  # id 0, an event of the first week
    got, want = both(spark, tmp_path, q_sampling.drift_by_week, q_sampling.QUERIES["drift_by_week"][1], events=(rows, "event_id long, user_id long, event_type string, ts timestamp"), embeddings=(vectors, "vec_id long, embedding array<float>"))
    assert got == want and got[0][:4] == (None, 1, 0, None)
