import math

import numpy as np
from pyspark.sql import functions as F

from threadloom.operators import retrieve, topics

LEAST, K, LEVELS = 20, 5, 6


def planted():
    """Two tight groups near each other, a wider one, and scattered vectors."""
    rng = np.random.default_rng(11)
    axes = np.eye(24)
    centres = [(axes[0], 0.05, 60), (axes[0] + 0.6 * axes[1], 0.05, 50), (axes[2], 0.12, 70)]
    rows = [(g, c + s * rng.standard_normal(24)) for g, (c, s, n) in enumerate(centres) for _ in range(n)]
    rows += [(-1, v) for v in rng.standard_normal((25, 24))]
    return [(i, g, v.tolist()) for i, (g, v) in enumerate(rows)]


def plain(rows):
    """The same tree by plain loops over all pairs."""
    ids = [r[0] for r in rows]
    m = np.array([r[2] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    d = np.round(1 - m @ m.T, 9)
    near = {i: sorted((d[i, j], j) for j in ids if j != i)[:K] for i in ids}
    core = {i: near[i][-1][0] for i in ids}
    ordered = sorted(core.values())
    bounds = sorted({ordered[math.ceil((i + 1) / LEVELS * len(ids)) - 1] for i in range(LEVELS)})
    sharp = [1 / x for x in bounds]
    below, held = {}, {}
    for level, bound in enumerate(bounds):
        root = {i: i for i in ids}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in ids:
            for x, j in near[i]:
                if max(x, core[i], core[j]) <= bound:
                    a, b = sorted((top(i), top(j)))
                    root[b] = a
        groups = {}
        for i in ids:
            if core[i] <= bound:
                groups.setdefault(top(i), set()).add(i)
        lasts = sharp[level] - sharp[min(level + 1, len(bounds) - 1)]
        now = {}
        for r, g in groups.items():
            if len(g) >= LEAST:
                kids = [v for v in below.values() if v[2] <= g]
                whole = len(g) * lasts + (kids[0][0] if len(kids) == 1 else 0)
                apart = sum(v[1] for v in kids)
                now[r] = (whole, max(whole, apart), g)
                if whole >= apart:
                    held.update(dict.fromkeys(g, (level, r)))
        below = now
    return held


def test_density_topics_are_those_of_plain_loops_and_find_what_is_planted(spark):
    rows = planted()
    v = spark.createDataFrame([(i, x) for i, _, x in rows], "id long, vector array<double>")
    exact = retrieve.top_k(v.withColumnRenamed("id", "query_id"), v, K + 1)
    got = {r.id: r.topic_key for r in topics.density_topics(v, LEAST, K, LEVELS, exact).collect()}
    want = plain(rows)
    assert len(got) == len(rows) and {i for i, t in got.items() if t >= 0} == set(want)
    assert len({(got[i], want[i]) for i in want}) == len(set(want.values())) == len({got[i] for i in want}) == 3
    for g in range(3):
        keys = [got[i] for i, h, _ in rows if h == g]
        assert max(map(keys.count, set(keys) - {-1})) >= 0.75 * len(keys)
    assert sum(got[i] == -1 for i, g, _ in rows if g == -1) >= 23


def test_density_topics_by_the_index_with_nulls_and_of_nothing(spark):
    rows = planted()
    v = spark.createDataFrame([(i, x) for i, _, x in rows] + [(9999, None)], "id long, vector array<double>")
    got = {r.id: r.topic_key for r in topics.density_topics(v, LEAST).collect()}
    assert len(got) == len(rows) + 1 and got[9999] == -1 and set(got.values()) == {-1, 0, 1, 2}
    assert topics.density_topics(v.filter(F.col("id") < 0), LEAST).count() == 0


def test_the_index_keeps_its_recall_in_clusters(spark):
    v = spark.createDataFrame([(i, x) for i, _, x in planted()], "id long, vector array<double>")
    q = v.withColumnRenamed("id", "query_id")
    assert retrieve.recall(retrieve.approximate_top_k(q, v, K + 1), retrieve.top_k(q, v, K + 1)) >= 0.9


def test_nearest_is_top_k_with_ties_nulls_and_few_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(230)] + [(i, [0.0] * 16) for i in (300, 301)] + [(400, None)]
    rows += [(500 + i, rows[3][1]) for i in range(9)]  # equal scores, more than k
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    q = v.withColumnRenamed("id", "query_id")
    monkeypatch.setattr(retrieve, "ASKED", 64)
    monkeypatch.setattr(retrieve, "CHUNK", 50)
    monkeypatch.setattr(retrieve, "PATCH", (16, 32))
    got = lambda found: {(r.query_id, r.rank): (r.id, round(r.score, 9) + 0.0) for r in found.collect()}
    for k in (1, 6):
        want = got(retrieve.top_k(q, v, k))
        assert got(retrieve.nearest(q, v, k)) == want and len(want) == k * 241
    few = v.filter("id < 3")
    assert got(retrieve.nearest(q, few, 6)) == got(retrieve.top_k(q, few, 6))
    assert retrieve.nearest(q.limit(0), v, 6).count() == 0


def test_vectors_without_clusters_are_not_compared_by_codes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = spark.createDataFrame([(i, rng.standard_normal(32).tolist()) for i in range(400)], "id long, vector array<float>")
    whole, search = [], retrieve.search_index

    def counting(queries, *more, **named):
        whole.append(queries.count())
        return search(queries, *more, **named)

    monkeypatch.setattr(retrieve, "search_index", counting)
    q = v.withColumnRenamed("id", "query_id")
    found = retrieve.approximate_top_k(q, v, K + 1)
    assert max(whole) <= retrieve.PROBED and retrieve.recall(found, retrieve.top_k(q, v, K + 1)) == 1.0
