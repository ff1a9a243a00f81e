"""Topics: hashed embeddings, clusters, keywords, labels, assignment, coherence."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..sources.shared import stored
from .retrieve import approximate_top_k
from .threads import components

TOP, FLOOR, OUTLIERS = 10, 1e-12, -1
MASKS = ("url", "user", "email", "phone", "emoji")


def embed(docs: DataFrame, dims: int = 256) -> DataFrame:
    """(id, vector): unit-length hashed TF-IDF of (id, text); other encoders plug in as DataFrame to DataFrame."""
    t = docs.select("id", word_tokens(F.col("text")).alias("tokens"))
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dims).transform(t)
    idf = IDF(inputCol="tf", outputCol="idf").fit(tf).transform(tf)
    return Normalizer(inputCol="idf", outputCol="unit").transform(idf).select("id", vector_to_array("unit", "float32").alias("vector"))


def kmeans_topics(vectors: DataFrame, k: int = 40, seed: int = 42) -> DataFrame:
    """(id, topic_key) by k-means over (id, vector)."""
    v = vectors.select("id", array_to_vector(F.col("vector")).alias("features"))
    return KMeans(k=k, seed=seed, predictionCol="topic_key").fit(v).transform(v).select("id", "topic_key")


def density_topics(vectors: DataFrame, least: int = 75, k: int = 5, levels: int = 6, near: DataFrame | None = None) -> DataFrame:
    """(id, topic_key) of (id, vector): dense groups by size from 0; what is in none is an outlier, -1, null vectors too.

    The core distance of a vector is that of its k-th neighbour by cosine; two neighbours are as far apart as the greatest of their
    distance and both core distances. Quantiles of the core distances are bounds, from dense to loose; at each bound the vectors whose
    core distance is within it fall into components, of which those of least vectors count. They form a tree: a component
    gathers its size times the span of 1 / bound for which it lasts, and stays a topic if no split of it gathers more.
    near: rows (query_id, id, score) of k + 1 neighbours or more; by default those of approximate_top_k. Edges between
    components are contracted from bound to bound, and nothing but the bounds passes through the driver.
    """
    known = vectors.filter("vector IS NOT NULL").select("id", "vector")
    near = approximate_top_k(known.withColumnRenamed("id", "query_id"), known, k + 1) if near is None else near
    far = near.filter("query_id <> id").select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round(1 - F.col("score"), 9).alias("d"))
    far = stored(far.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).filter(F.col("k") <= k))
    core = far.groupBy("a").agg(F.max("d").alias("core"))
    found = core.agg(F.percentile_approx("core", [(i + 1) / levels for i in range(levels)], 10_000)).first()[0]
    bounds = sorted(set(found or []))
    sharp = [1 / max(x, 1e-9) for x in bounds]
    edges = far.join(core, "a").join(core.toDF("b", "other"), "b").select("a", "b", F.greatest("d", "core", "other").alias("d"))
    labels, tree, topics = core.select(F.col("a").alias("id"), F.col("a").alias("root")), None, None
    for i, bound in enumerate(bounds):
        joined = components(labels.select(F.col("root").alias("id")).distinct(), edges.filter(F.col("d") <= bound).select(F.col("a").alias("src"), F.col("b").alias("dst")))
        up = stored(joined.select(F.col("id").alias("low"), F.col("root").alias("high")))
        labels = stored(labels.join(up, F.col("root") == F.col("low")).select("id", F.col("high").alias("root")))
        edges = edges.filter(F.col("d") > bound).join(up.toDF("a", "ra"), "a").join(up.toDF("b", "rb"), "b").filter("ra <> rb")
        edges = stored(edges.groupBy(F.col("ra").alias("a"), F.col("rb").alias("b")).agg(F.min("d").alias("d")))
        members = labels.join(core.filter(F.col("core") <= bound), F.col("id") == F.col("a"), "left_semi")
        now = members.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        lasts = sharp[i] - sharp[min(i + 1, len(bounds) - 1)]
        if tree is None:
            now = now.select("root", F.lit(0).alias("parts"), F.lit(0.0).alias("apart"), (F.col("n") * lasts).alias("whole"))
        else:
            parts = tree.join(up, F.col("root") == F.col("low")).groupBy("high").agg(F.count("*").alias("parts"), F.sum("best").alias("apart"), F.sum("whole").alias("same"))
            whole = F.col("n") * lasts + F.when(F.col("parts") == 1, F.col("same")).otherwise(0.0)
            now = now.join(parts, F.col("root") == F.col("high"), "left").select("root", "parts", F.coalesce("apart", F.lit(0.0)).alias("apart"), whole.alias("whole"))
        tree = stored(now.withColumn("best", F.greatest("whole", "apart")))
        held = members.join(tree.filter("whole >= apart").select("root"), "root").select("id", F.struct(F.lit(i).alias("level"), "root").alias("topic"))
        topics = held if topics is None else topics.unionByName(held)
    if topics is None:
        return vectors.select("id", F.lit(OUTLIERS).alias("topic_key"))
    topics = stored(topics.groupBy("id").agg(F.max("topic").alias("topic")))  # the loosest that holds
    size = topics.groupBy("topic").agg(F.count("*").alias("n"))
    keys = size.select("topic", (F.row_number().over(Window.orderBy(F.desc("n"), "topic.root")) - 1).alias("topic_key"))
    return vectors.select("id").join(topics.join(keys, "topic").select("id", "topic_key"), "id", "left").select("id", F.coalesce("topic_key", F.lit(OUTLIERS)).alias("topic_key"))


def topic_terms(docs: DataFrame, stop: list[str]) -> DataFrame:
    """(topic, term, tf) of (topic, text): words of two characters or more, stop and mask words left out."""
    t = docs.select("topic", F.explode(word_tokens(F.col("text"))).alias("term")).filter(F.length("term") >= 2)
    return t.filter(~F.col("term").isin(*stop, *MASKS)).groupBy("topic", "term").agg(F.count("*").alias("tf"))


def cluster_keywords(terms: DataFrame, n: int = TOP) -> DataFrame:
    """(topic, term, rank): the most frequent terms of each topic, ties by term."""
    k = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("tf"), "term"))
    return terms.withColumn("rank", k).filter(F.col("rank") <= n)


def class_tfidf(terms: DataFrame, n: int = TOP) -> DataFrame:
    """(topic, term, weight, rank) by tf * ln(1 + A / f): A the mean number of words a topic, f the term's count in all."""
    total = terms.groupBy("topic").agg(F.sum("tf").alias("w")).agg(F.avg("w").alias("a"))
    f = terms.groupBy("term").agg(F.sum("tf").alias("f"))
    weighed = terms.join(f, "term").crossJoin(F.broadcast(total)).withColumn("weight", F.round(F.col("tf") * F.log(1 + F.col("a") / F.col("f")), 6))  # one row
    k = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))
    return weighed.withColumn("rank", k).filter(F.col("rank") <= n).select("topic", "term", "weight", "rank")


def catalog(assigned: DataFrame, keywords: DataFrame) -> DataFrame:
    """(topic, size, keywords, label): label is the first four keywords, `outliers` for -1."""
    words = keywords.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
    t = assigned.groupBy("topic").agg(F.count("*").alias("size")).join(words, "topic", "left")
    label = F.when(F.col("topic").cast("string") == "-1", "outliers").otherwise(F.array_join(F.slice("keywords", 1, 4), ", "))
    return t.select("topic", "size", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), label.alias("label"))


def assign(assigned: DataFrame, topics: DataFrame) -> DataFrame:
    """Prediction rows (id, task, topic, label, keywords); topics without an entry are `unlabeled`."""
    t = topics.select("topic", "label", "keywords")
    return assigned.join(t, "topic", "left").select("id", F.lit("topic").alias("task"), "topic", F.coalesce("label", F.lit("unlabeled")).alias("label"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def largest(topics: DataFrame, n: int = 30) -> DataFrame:
    return topics.filter(F.col("topic").cast("string") != "-1").orderBy(F.desc("size"), "topic").limit(n)


def clean_name(c):
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), "^[\"'“”]+|[\"'“”]+$", ""), r"\.+$", ""))


def coherence(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(topic, npmi) of (topic, text) and top terms (topic, term): mean normalised pointwise mutual information of a topic's
    term pairs over documents; under two terms 0."""
    terms = keywords.select("topic", "term").distinct()
    n = docs.agg(F.count("*").alias("n"))
    held = docs.select("id", F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term")).join(terms, "term")
    single = held.groupBy("topic", "term").agg(F.count("*").alias("k"))
    per_doc = held.groupBy("id", "topic").agg(F.array_sort(F.collect_list("term")).alias("terms")).filter("size(terms) > 1")  # a topic's terms, ten at most
    pairs = per_doc.select("topic", F.explode(F.flatten(F.transform("terms", lambda a: F.transform(F.filter("terms", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("topic", "p.*")
    both = pairs.groupBy("topic", "a", "b").agg(F.count("*").alias("ab"))
    sides = terms.withColumnRenamed("term", "a").join(terms.withColumnRenamed("term", "b"), "topic").filter("a < b")
    s = sides.join(both, ["topic", "a", "b"], "left").join(single.toDF("topic", "a", "ka"), ["topic", "a"], "left").join(single.toDF("topic", "b", "kb"), ["topic", "b"], "left").crossJoin(F.broadcast(n))  # one row
    p = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)) / F.col("n"), F.lit(FLOOR))
    npmi = F.when(p("ab") >= 1, 1.0).otherwise(F.log(p("ab") / (p("ka") * p("kb"))) / -F.log(p("ab")))
    means = s.groupBy("topic").agg(F.avg(npmi).alias("npmi"))
    return keywords.select("topic").distinct().join(means, "topic", "left").select("topic", F.coalesce("npmi", F.lit(0.0)).alias("npmi"))


def variant_stats(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("variant").agg(F.countDistinct(F.when(F.col("topic") != OUTLIERS, F.col("topic"))).alias("topics"), F.count_if(F.col("topic") == OUTLIERS).alias("outliers"))
