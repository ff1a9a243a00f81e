import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import spans as H
from threadloom.operators import tagger


@pytest.mark.parametrize("seed", range(4))
def test_best_path_against_all_paths(seed):
    tags, r = tagger.Tags(("A", "B")), np.random.default_rng(seed)
    n = len(tags.names)
    emit, moves = r.normal(size=(4, n)), r.normal(size=(n, n))

    def worth(path):
        return tags.first[path[0]] + sum(emit[i][t] for i, t in enumerate(path)) + sum(moves[a][b] + tags.barred[a][b] for a, b in itertools.pairwise(path))

    assert tuple(tagger.best_path(emit, moves, tags)) == max(itertools.product(range(n), repeat=4), key=worth)


def test_gold_tags():
    tags = tagger.Tags(("A", "B"))
    offsets, ids = tagger.places("Pay $5.00 on 3 May")
    got = tagger.gold_tags(offsets, [{"start": 13, "end": 18, "label": "B"}, {"start": 4, "end": 9, "label": "A"}, {"start": 0, "end": 3, "label": "X"}], tags)
    assert [tags.names[t] for t in got] == ["O", "B-A", "I-A", "I-A", "I-A", "O", "B-B", "I-B"] and ids.shape == (8, 12)
    assert tagger.places("")[1].shape == (0, 12)


def test_one_pass_against_dense_averaging():
    """The mean of all steps' weights, added up step by step."""
    import pandas as pd

    tags = tagger.Tags(("A",))
    rows = pd.DataFrame({"text": ["pay 5 now", "pay 7", "", "now 5"], "entities": [[{"start": 4, "end": 5, "label": "A"}], [{"start": 4, "end": 5, "label": "A"}], None, None]})
    start = np.zeros((tagger.PLACES + 3, 3))
    w, total, steps = start.copy(), start.copy(), 1
    for text, spans in zip(rows["text"], rows["entities"], strict=True):
        offsets, ids = tagger.places(text)
        if not offsets:
            continue
        want, got = tagger.gold_tags(offsets, spans, tags), tagger.best_path(tagger.scores(w, ids), w[tagger.PLACES :], tags)
        for path, by in ((want, 1), (got, -1)):
            for i in range(len(ids)):
                for f in ids[i]:
                    w[f, path[i]] += by
                if i:
                    w[tagger.PLACES + path[i - 1], path[i]] += by
        total += w
        steps += 1
    out = tagger._pass(rows, start, tags)
    last, mean = np.zeros(start.size), np.zeros(start.size)
    last[out["cell"]], mean[out["cell"]] = out["last"], out["mean"]
    assert np.array_equal(last.reshape(start.shape), w)
    assert np.allclose(mean.reshape(start.shape), total / steps)


def test_held_out_spans_are_found(spark):
    r = H.render_templates(spark.range(600).withColumnRenamed("id", "doc_id"), "doc_id").select("id", "text", "entities")
    weights = tagger.train(r.filter("id % 4 <> 0"), most=300)
    rows = tagger.annotated(r.filter("id % 4 = 0"), weights).collect()
    want = {(x.id, s.start, s.end, s.label) for x in rows for s in x.entities}
    got = {(x.id, s.start, s.end, s.label) for x in rows for s in x.model}
    right = len(want & got)
    assert 2 * right / (len(want) + len(got)) >= 0.9
    assert all(s.text == x.text[s.start : s.end] and 0.5 < s.score <= 1 for x in rows for s in x.model) and not any(x.truncated for x in rows)


def test_truncated_is_carried_and_empty_rows_stay(spark):
    r = H.render_templates(spark.range(40).withColumnRenamed("id", "doc_id"), "doc_id").select("id", "text", "entities")
    weights = tagger.train(r)
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five"), (4, "one"), (5, "é中 " * 30_000)], "id long, text string").withColumn("label", F.lit("own"))
    cut = {x.id: x.truncated for x in tagger.annotated(texts, weights, most=3).collect()}
    assert cut == {1: False, 2: False, 3: True, 4: False, 5: True}
    whole = tagger.annotated(texts, weights).collect()
    assert sorted(x.id for x in whole) == [1, 2, 3, 4, 5] and not any(x.truncated for x in whole) and {x.label for x in whole} == {"own"}
    assert not tagger.train(r.limit(0)).any()


def test_texts_together_are_tagged_like_each_alone():
    texts = ["Order 48213 on March 3, please", "", "x", "É́cole_9 😀 $25.50!", "a b c d e f g " * 30]
    tags, rng = tagger.Tags(tagger.LABELS), np.random.default_rng(3)
    weights = rng.normal(size=(tagger.PLACES + len(tags.names), len(tags.names))).astype(np.float32)
    sizes, offsets, ids = tagger.features(texts)
    path = tagger.best_paths(tagger.scores(weights, ids), sizes, weights[tagger.PLACES :], tags)
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends, strict=True):
        alone, own = tagger.places(text)
        assert [tuple(x) for x in offsets[a:b].tolist()] == alone and (ids[a:b] == own).all()
        if alone:
            assert (path[a:b] == tagger.best_path(tagger.scores(weights, own), weights[tagger.PLACES :], tags)).all()


def _odd(spark):
    """1,100 sentences; one alone, not among the 1,000 of the least hashes, has a span of its label."""
    from threadloom.functions.text import seeded

    ids = spark.range(1_100)
    last = ids.orderBy(seeded(F.col("id"), "tagger").desc(), F.desc("id")).first().id
    span = lambda a, b, label: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(label).alias("label"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("score"))).cast(H.SPANS)
    return ids.select("id", F.when(F.col("id") == last, "the zyx is here").otherwise("pay 5 now").alias("text"), F.when(F.col("id") == last, span(4, 7, "PRODUCT")).otherwise(span(4, 5, "AMOUNT")).alias("entities")), last


def test_all_examples_teach(spark):
    examples, last = _odd(spark)
    said = examples.filter(F.col("id").isin(last, (last + 1) % 1_100)).select("id", "text")
    got = {x.id: [(s.start, s.end, s.label) for s in x.model] for x in tagger.annotated(said, tagger.train(examples)).collect()}
    assert got == {last: [(4, 7, "PRODUCT")], (last + 1) % 1_100: [(4, 5, "AMOUNT")]}


def test_registered_annotators_learn_from_all_documents(spark, monkeypatch):
    from threadloom.plans import q_spans

    taught, train = [], tagger.train

    def counting(examples, *more, **named):
        taught.append((examples.count(), more, named))
        return train(examples.limit(0))

    monkeypatch.setattr(tagger, "train", counting)
    for query in (q_spans.hybrid_tagged, q_spans.union_tagged):
        query(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert taught == [(n, (), {})] * 2


@pytest.mark.parametrize("kind", [np.float64, np.float32])
def test_paths_between_certain_tokens_are_the_best_ones(kind):
    tags, rng = tagger.Tags(tagger.LABELS), np.random.default_rng(5)
    sizes = np.array([0, 3, 0, 0, 400, 1, 60, 0])
    for ahead in (0.0, 3.0, 30.0):
        emit = np.round(rng.normal(size=(sizes.sum(), len(tags.names))) * 4).astype(kind)
        emit[:, 0] += ahead
        moves = rng.integers(-3, 4, size=(len(tags.names),) * 2).astype(kind)
        path = tagger.best_paths(emit, sizes, moves, tags)
        sure = tagger.certain(emit, sizes, moves, tags)
        assert not path[sure].any() and (ahead < 30 or sure.mean() > 0.9)
        worth = lambda e, p: tags.first[p[0]] + e[np.arange(len(e)), p].sum() + (moves + tags.barred)[p[:-1], p[1:]].sum()
        for b, n in zip(np.cumsum(sizes), sizes, strict=True):
            if n:
                alone = tagger.best_path(emit[b - n : b], moves, tags)
                assert worth(emit[b - n : b], path[b - n : b]) == worth(emit[b - n : b], alone)


def test_one_pass_in_parts_is_the_pass_text_by_text(monkeypatch):
    """Texts tagged ahead, in several parts, move weights as each alone does."""
    import pandas as pd

    tags, rng = tagger.Tags(tagger.LABELS), np.random.default_rng(8)
    words = ["pay", "5", "now", "Kindle", "on", "May", "3", "", "x9"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(300)]
    gold = [[{"start": t.index("5"), "end": t.index("5") + 1, "label": "AMOUNT"}] if "5" in t else None for t in texts]
    rows = pd.DataFrame({"text": texts, "entities": gold})
    start = np.zeros((tagger.PLACES + len(tags.names), len(tags.names)))
    whole = tagger._pass(rows, start, tags)
    monkeypatch.setattr(tagger, "TAUGHT", 1)
    pd.testing.assert_frame_equal(whole, tagger._pass(rows, start, tags))
    monkeypatch.setattr(tagger, "AHEAD", 1)
    pd.testing.assert_frame_equal(whole, tagger._pass(rows, start, tags))
