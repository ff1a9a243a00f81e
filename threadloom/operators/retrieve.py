"""Similar-case retrieval in table form: batches of queries against a corpus of vectors, gates, sources, prompts, ledger."""

from __future__ import annotations

import uuid

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, lean, shared_dir

TOP_K, POOL, SOURCES, MIN_SCORE = 5, 10, 4, 0.0
#: Vectors of a block of queries and of the corpus, about.
BLOCK, CHUNK = 1024, 4096
#: Queries whose scores against a block of the corpus are held at once.
ROWS = 64
#: An index: rows its cells are learned from and their number, at most; bits of a code; rows whose codes are compared to find the
#: distance that a share CLOSE of pairs does not exceed, beyond which codes are passed over.
SAMPLE, MOST_CELLS, BITS, PAIRED, CLOSE = 20_000, 1_024, 512, 1_000, 0.06
#: Queries that choose the number of probes.
PROBED = 64
#: Tasks that share an index of which all is read, for each block of queries, at most; files whose best are held before they are trimmed.
READERS, HELD = 8, 16
#: Cells up to which a query is copied for each that it reads; an index of which more than one part in PRUNED is read saves no time.
COPIES, PRUNED = 8, 8
#: Queries of a block of nearest(), about, and rows and columns of the scores that are made at once.
ASKED, PATCH = 8192, (256, 2048)
STOP = "a about after all an and any are as at be been but by can do for from had has have he her his how i if in into is it its me my no not of on or our out so than that the their them then there they this to up was we were what when which who will with you your".split()


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def pool_size(top_k: int, rerank: bool) -> int:
    return max(top_k, POOL) * (4 if rerank else 1)


def _blocks(rows: DataFrame, ident: str, size: int) -> DataFrame:
    """(v): arrays of about size structs (id, vector), dealt by hash."""
    n = -(-rows.count() // size) or 1
    return rows.filter("vector IS NOT NULL").groupBy(F.pmod(F.xxhash64(ident), F.lit(n)).alias("b")).agg(F.collect_list(F.struct(F.col(ident).alias("id"), F.col("vector").cast("array<double>").alias("vector"))).alias("v")).select("v")


def top_k(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, where: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank): for queries (query_id, vector) the k nearest of corpus (id, vector, ...) by cosine.

    A block of queries meets each block of the corpus in one task as one matrix product of unit vectors, which gives k
    candidates a query; a window over those is exact. Neither side passes through the driver. A zero vector scores 0.
    """
    import numpy as np
    import pyarrow as pa

    rows = corpus.filter(where) if where is not None else corpus
    pairs = _blocks(queries.select("query_id", "vector"), "query_id", BLOCK).toDF("q").crossJoin(_blocks(rows.select("id", "vector"), "id", CHUNK).toDF("c"))  # all blocks of stated queries with all of the corpus
    shape = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(corpus.dtypes)['id']}, score double"

    def side(block) -> tuple:
        flat = block.values
        vectors = flat.field("vector")
        m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
        return flat.field("id"), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)

    def near(batches):
        for b in batches:
            for q, c in zip(b.column(0), b.column(1), strict=True):
                (qi, qm), (ci, cm) = side(q), side(c)
                names, n = ci.to_numpy(zero_copy_only=False), min(k, len(ci))
                at, to, score = [], [], []
                for first in range(0, len(qm), ROWS):
                    s = qm[first : first + ROWS] @ cm.T
                    low = -np.round(s, 9)
                    last = np.partition(low, n - 1, axis=1)[:, n - 1]
                    for i, row in enumerate(low):
                        some = np.flatnonzero(~(row > last[i]))  # the best n and what equals the last of them
                        best = some[np.lexsort((names[some], row[some]))[:n]]
                        at.append(np.full(n, first + i))
                        to.append(best)
                        score.append(s[i, best])
                at, to, score = (np.concatenate(x) for x in (at, to, score))
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(at)), ci.take(pa.array(to)), pa.array(score)], ["query_id", "id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return pairs.mapInArrow(lean(near), shape).withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, corpus: DataFrame, k: int = TOP_K) -> DataFrame:
    """As top_k(), for queries that are as many as the corpus. A task keeps the best of all blocks of the corpus that a block of queries
    meets there; of products of single precision only what may still be among them is scored in double precision."""
    import numpy as np
    import pyarrow as pa

    spark = corpus.sparkSession
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "id": dict(corpus.dtypes)["id"]}

    def packed(rows: DataFrame, ident: str, size: int) -> DataFrame:
        """(ids, m): about size ids and their unit vectors, dealt by hash."""

        def block(batches):
            for b in batches:
                for v in b.column(0):
                    yield pa.RecordBatch.from_arrays([pa.array([v.values.field("id")], pa.list_(v.values.field("id").type)), pa.array([_units(v.values.field("vector")).tobytes()])], ["ids", "m"])

        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return cut(_blocks(rows, ident, size).repartition(parts).mapInArrow(lean(block), f"ids array<{kinds[ident]}>, m binary"))

    def trimmed(held: list[tuple]) -> tuple:
        """The best k of each query, equal ones by id, in order of queries."""
        at, score = (np.concatenate([x[j] for x in held]) for j in (0, 2))
        names = pa.concat_arrays([x[1] for x in held])
        order = np.lexsort((names.to_numpy(zero_copy_only=False), -np.round(score, 9), at))
        own = at[order]
        stays = order[np.arange(len(own)) - np.searchsorted(own, own) < k]
        return at[stays], names.take(pa.array(stays)), score[stays]

    def bars(best: tuple, size: int):
        """The score of the k-th best of each query, below all where there are fewer."""
        at, _, score = best
        n, bar = np.bincount(at, minlength=size), np.full(size, -2.0)
        full = np.flatnonzero(n >= k)
        bar[full] = score[(np.cumsum(n) - n)[full] + k - 1]
        return bar

    def met(qm, cm, names, best: tuple | None) -> tuple:
        q, c, spare = qm.astype(np.float32), cm.astype(np.float32), 2e-6 + 2e-7 * qm.shape[1]
        for left in range(0, len(cm), PATCH[1]):
            found, bar = [], np.full(len(qm), -2.0) if best is None else bars(best, len(qm))
            for top in range(0, len(qm), PATCH[0]):
                s = q[top : top + PATCH[0]] @ c[left : left + PATCH[1]].T
                least = bar[top : top + PATCH[0]].astype(np.float32)
                if best is None and s.shape[1] > k:
                    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                hit = np.flatnonzero(s >= (least - np.float32(spare))[:, None])
                found.append((top + hit // s.shape[1], left + hit % s.shape[1]))
            at, to = (np.concatenate(x) for x in zip(*found, strict=True))
            new = at, names.take(pa.array(to)), np.einsum("ij,ij->i", qm[at], cm[to])
            best = trimmed([new] if best is None else [best, new])
        return best

    def near(batches):
        now = best = qm = None
        for batch in batches:
            for asked, q, names, c in zip(*(batch.column(i) for i in range(4)), strict=True):
                if now is None or not asked.equals(now):
                    if now is not None:
                        yield given(now, best)
                    now, best, qm = asked, None, np.frombuffer(q.as_buffer()).reshape(len(asked), -1)
                best = met(qm, np.frombuffer(c.as_buffer()).reshape(len(names), -1), names.values, best)
        if now is not None:
            yield given(now, best)

    def given(asked, best: tuple):
        at, names, score = best
        return pa.RecordBatch.from_arrays([asked.values.take(pa.array(at)), names, pa.array(score)], ["query_id", "id", "score"])

    blocks = packed(queries.select("query_id", "vector"), "query_id", ASKED).toDF("asked", "q").crossJoin(packed(corpus.select("id", "vector"), "id", CHUNK).coalesce(READERS))  # all blocks of queries with all of the corpus
    found = blocks.mapInArrow(lean(near), f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def build_index(corpus: DataFrame, path: str, seed: int = 7) -> DataFrame:
    """An index of corpus (id, vector), written to path by cell and read back: (cell, chunk, v), v the ids, codes and unit vectors of
    at most about CHUNK rows of a cell.

    Cells are k-means cells of SAMPLE rows at most, those of least hash; every row is in the cell of its nearest centre. A code is
    the signs of BITS random projections, and beside the index lie the cells' centres and the distance of codes up to which vectors are
    compared, that of CLOSE of the pairs of PAIRED rows. Null vectors are left out; zero vectors have a cell like others and score 0.
    """
    import numpy as np
    import pyarrow as pa

    rows = corpus.filter("vector IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("vector"))
    count = rows.count()
    cells = max(1, min(MOST_CELLS, int(count**0.5)))
    some = rows.orderBy(F.xxhash64("id", F.lit(seed))).limit(SAMPLE).select(array_to_vector("vector").alias("v"))
    unit = Normalizer(inputCol="v", outputCol="features").transform(some)
    centres = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(unit).clusterCenters()) if count else np.zeros((1, 1))
    paired = _codes(np.array([r.v.toArray() for r in some.limit(PAIRED).collect()]), seed) if count else np.zeros((1, BITS // 64), np.uint64)
    apart = np.sort(np.concatenate([np.bitwise_count(paired[i + 1 :] ^ row).sum(1) for i, row in enumerate(paired)]))
    within = int(apart[int(CLOSE * len(apart))]) if len(apart) else BITS
    shape = f"cell int, id {dict(corpus.dtypes)['id']}, code array<long>, vector array<double>"

    def placed(batches):
        for b in batches:
            if b.num_rows:
                m = _units(b.column(1))
                near = (2 * m @ centres.T - (centres**2).sum(1)).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(near), b.column(0), pa.array(list(_codes(m, seed).view(np.int64)), pa.list_(pa.int64())), pa.array(list(m), pa.list_(pa.float64()))], ["cell", "id", "code", "vector"])

    known = cut(rows.mapInArrow(placed, shape))
    chunks = known.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = known.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))  # MOST_CELLS rows
    blocks = dealt.groupBy("cell", "chunk").agg(F.collect_list(F.struct("id", "code", "vector")).alias("v"))
    blocks.write.partitionBy("cell").parquet(path)
    spark = corpus.sparkSession
    spark.createDataFrame([(i, c.tolist(), within) for i, c in enumerate(centres)], "cell int, centre array<double>, within int").write.parquet(f"{path}-centres")
    return spark.read.schema(blocks.schema).parquet(path)


def _units(vectors):
    """The vectors of an Arrow column as rows of unit length."""
    import numpy as np

    m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def _codes(m, seed: int):
    """The signs of BITS random projections of each row, as 64-bit words."""
    import numpy as np

    signs = m @ np.random.default_rng(seed).standard_normal((m.shape[1], BITS)) > 0
    return np.packbits(signs, axis=1).view(np.uint64)


def search_index(queries: DataFrame, path: str, k: int = TOP_K, probes: int | None = None, seed: int = 7, within: int | None = None) -> DataFrame:
    """(query_id, id, score, rank, compared): the k best of an index for queries (query_id, vector), codes compared up to the
    index's distance or that of within.

    A query reads its `probes` nearest cells (all without a number); other cells' files are pruned. There, codes too
    far from the query's are passed over; the rest, compared in number, is scored exactly.
    """
    import numpy as np
    import pyarrow as pa

    spark = queries.sparkSession
    index = spark.read.parquet(path)
    known = spark.read.parquet(f"{path}-centres").orderBy("cell").collect()  # MOST_CELLS at most
    centres, within, wanted = np.array([r.centre for r in known]), known[0].within if within is None else within, probes or len(known)
    shape = f"query_id {dict(queries.dtypes)['query_id']}, cells array<int>, vector array<double>"

    def routed(batches):
        for b in batches:
            if b.num_rows:
                m = _units(b.column(1))
                order = np.argsort((centres**2).sum(1) - 2 * m @ centres.T, axis=1)[:, :wanted].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(order), pa.list_(pa.int32())), pa.array(list(m), pa.list_(pa.float64()))], ["query_id", "cells", "vector"])

    asked = queries.filter("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(routed, shape)
    ids, answer = dict(queries.dtypes)["query_id"], index.schema["v"].dataType.elementType["id"].dataType.simpleString()
    if wanted <= COPIES:
        asked = asked.select("query_id", "vector", F.explode("cells").alias("cell"))
        sizes = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        asked = asked.join(F.broadcast(sizes), "cell").groupBy("cell", F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("b")).agg(F.collect_list(F.struct("query_id", "vector")).alias("q"))
        pairs = asked.join(index, "cell").select("b", "q", "cell", "v")
    else:  # every block of queries meets every file; vectors are not copied for each cell, and a task keeps the best of all it reads
        n = asked.count() // BLOCK + 1
        parts = min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
        asked = asked.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("b")).repartition(parts, "b").groupBy("b").agg(F.collect_list(F.struct("query_id", "vector")).alias("q"))
        pairs = asked.crossJoin(index.select("cell", "v").coalesce(READERS)).select("b", "q", "cell", "v")

    def met(q, c, asks) -> tuple:
        """Places in q and c of the best k of each query, and what equals the last of them; their scores; how many were compared."""
        qm, cm = _units(q.field("vector")), _units(c.field("vector"))
        codes = c.field("code").flatten().to_numpy().reshape(len(c), -1).view(np.uint64)
        at, to, score, compared = [], [], [], np.zeros(len(q), np.int64)
        for i, (row, code) in enumerate(zip(qm, _codes(qm, seed), strict=True)):
            if not asks[i]:
                continue
            some = np.nonzero(np.bitwise_count(codes ^ code).sum(1) <= within)[0]
            s = cm[some] @ row
            best = np.argsort(-np.round(s, 9), kind="stable")[:k]
            if len(s) > k:  # equal scores at the end stay together
                best = np.nonzero(np.round(s, 9) >= np.round(s[best[-1]], 9))[0]
            at.append(np.full(len(best), i))
            to.append(some[best])
            score.append(s[best])
            compared[i] = len(some)
        return *(np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((at, int), (to, int), (score, float))), compared

    def trimmed(held: list[tuple]) -> list[tuple]:
        """The best k of each query of a block, and what equals the last of them, of what several files gave."""
        at, score = (np.concatenate([x[j] for x in held]) for j in (0, 2))
        names = pa.concat_arrays([x[1] for x in held])
        order = np.lexsort((-np.round(score, 9), at))
        own = at[order]
        last = np.minimum(np.searchsorted(own, own) + k, np.searchsorted(own, own, "right")) - 1
        stays = order[np.round(score[order], 9) >= np.round(score[order][last], 9)]
        return [(at[stays], names.take(pa.array(stays)), score[stays], np.sum([x[3] for x in held], axis=0))]

    def given(q, held: list[tuple]):
        ((at, names, score, compared),) = trimmed(held)
        first = np.append(True, at[1:] != at[:-1])[: len(at)]
        return pa.RecordBatch.from_arrays([q.field("query_id").take(pa.array(at, pa.int64())), names, pa.array(score, pa.float64()), pa.array(np.where(first, compared[at], 0))], ["query_id", "id", "score", "compared"])

    def near(batches):
        now, held = None, []
        for batch in batches:
            for q, cell, c in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                q, c = q.values, c.values
                if held and not q.field("query_id").equals(now.field("query_id")):
                    yield given(now, held)
                    held = []
                if now is None or not q.field("query_id").equals(now.field("query_id")):
                    asks = np.ones((len(q), len(known)), bool)
                    if COPIES < wanted < len(known):  # a query reads its own cells only
                        asks[:] = False
                        np.put_along_axis(asks, np.argsort((centres**2).sum(1) - 2 * _units(q.field("vector")) @ centres.T, axis=1)[:, :wanted], True, axis=1)
                now = q
                if not asks[:, cell].any():
                    continue
                at, to, score, compared = met(q, c, asks[:, cell])
                held.append((at, c.field("id").take(pa.array(to, pa.int64())), score, compared))
                if len(held) >= HELD:
                    held = trimmed(held)
        if held:
            yield given(now, held)

    found = pairs.mapInArrow(lean(near), f"query_id {ids}, id {answer}, score double, compared long")
    own = Window.partitionBy("query_id")
    rank = F.row_number().over(own.orderBy(F.desc(F.round("score", 9)), "id"))
    return found.withColumns({"rank": rank, "compared": F.sum("compared").over(own)}).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank", "compared")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's rows (query_id, id) that found has."""
    r = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
    return 1.0 if r is None else r


def fewest_probes(queries: DataFrame, corpus: DataFrame, path: str, k: int = TOP_K, least: float = 0.9, within: int | None = None) -> int:
    """The number of probes, by doubling, with which the index at path reaches a recall of least for PROBED of the queries at most,
    against exact search; all cells where no smaller number does, as in vectors without clusters."""
    some = queries.orderBy(F.xxhash64("query_id")).limit(PROBED)
    exact = cut(top_k(some, corpus, k))
    cells, probes = corpus.sparkSession.read.parquet(f"{path}-centres").count(), 1
    while probes < cells and recall(search_index(some, path, k, probes, within=within), exact) < least:
        probes *= 2
    return min(probes, cells)


def code_distance(queries: DataFrame, corpus: DataFrame, path: str, k: int = TOP_K, least: float = 0.9, seed: int = 7) -> int:
    """The distance of codes to search the index at path with: its own if a share least of the k exact neighbours of PROBED
    queries at most is within it, else, as in clusters that are a large part of all pairs, that of a share halfway from least to 1."""
    import numpy as np

    some = queries.filter("vector IS NOT NULL").orderBy(F.xxhash64("query_id")).limit(PROBED)
    pairs = top_k(some, corpus, k).join(some.select("query_id", F.col("vector").alias("q")), "query_id").join(corpus.select("id", "vector"), "id")
    pairs = pairs.select(F.col("q").cast("array<double>"), F.col("vector").cast("array<double>")).collect()  # k for each of PROBED queries
    own = corpus.sparkSession.read.parquet(f"{path}-centres").first().within
    if not pairs:
        return own
    q, v = (_codes(np.array([r[i] for r in pairs]), seed) for i in (0, 1))
    apart = np.sort(np.bitwise_count(q ^ v).sum(1))
    return own if (apart <= own).mean() >= least else max(own, int(apart[int((1 + least) / 2 * (len(apart) - 1))]))


def approximate_top_k(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, least: float = 0.9) -> DataFrame:
    """As top_k(), by an index of corpus with as few probes as reach a recall of least, or by nearest() where those are a large part of
    its cells, as in vectors without clusters. A corpus without vectors gives no rows."""
    if corpus.filter("vector IS NOT NULL").isEmpty():
        return top_k(queries, corpus, k)
    path = f"{shared_dir(corpus.sparkSession)}/index-{uuid.uuid4().hex}"
    build_index(corpus, path)
    within = code_distance(queries, corpus, path, k, least)
    probes = fewest_probes(queries, corpus, path, k, least, within)
    if PRUNED * probes > corpus.sparkSession.read.parquet(f"{path}-centres").count():
        return nearest(queries, corpus, k)
    return search_index(queries, path, k, probes, within=within).drop("compared")


def retrieve(queries: DataFrame, collections: dict[str, DataFrame], k: int = TOP_K, exclude: DataFrame | None = None) -> DataFrame:
    """(query_id, kind, id, score, rank) over all collections, without the pairs (query_id, id) of exclude."""
    hits, more = None, 0
    if exclude is not None:  # each query may lose as many hits as it excludes
        exclude = exclude.select("query_id", "id").distinct()
        more = exclude.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for kind, corpus in collections.items():
        part = top_k(queries, corpus, k + more).select("query_id", F.lit(kind).alias("kind"), "id", "score")
        hits = part if hits is None else hits.unionByName(part)
    if exclude is not None:
        hits = hits.join(exclude, ["query_id", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "kind", "id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def words_of(c: Column) -> Column:
    return F.array_except(F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " ")), " "), lambda w: w != ""), F.array(*[F.lit(w) for w in STOP]))


def lexical_score(query: Column, document: Column) -> Column:
    """Share of the query's words that the document has; a stand-in for a pair scorer."""
    q = words_of(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words_of(document))) / F.size(q)).otherwise(0.0)


def scored_words(c: Column) -> Column:
    """The words of a text that are no stop words, repeats kept."""
    return F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_]+", " ")), " "), lambda w: (w != "") & ~w.isin(*STOP))


def bm25(pairs: DataFrame, queries: DataFrame, texts: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """pairs (query_id, id, ...) with bm25, over queries (query_id, text) and the collection texts (id, text); ids are unique.

    Frequencies and the mean length are of the whole collection: its words are counted as distinct words of a text, partly before the
    shuffle, so that a frequent word is one row a task. Postings are made of the texts in pairs alone and meet the words of a query by
    (id, word). Null and empty texts, ids that the collection lacks and queries without words score 0.
    """
    held = texts.select("id", scored_words(F.col("text")).alias("words"))
    frequency = held.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    size = held.agg(F.count(F.lit(1)).alias("texts"), F.avg(F.size("words")).alias("mean"))  # one row
    postings = held.join(pairs.select("id").distinct(), "id", "left_semi").select("id", F.size("words").alias("length"), F.explode("words").alias("word")).groupBy("id", "length", "word").agg(F.count(F.lit(1)).alias("tf"))
    asked = queries.join(pairs.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.explode(F.array_distinct(scored_words(F.col("text")))).alias("word")).join(frequency, "word")
    weight = F.log(1 + (F.col("texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    sums = pairs.select("query_id", "id").distinct().join(asked, "query_id").join(postings, ["id", "word"]).crossJoin(F.broadcast(size)).groupBy("query_id", "id").agg(F.sum(part).alias("bm25"))
    return pairs.join(sums, ["query_id", "id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def rerank(hits: DataFrame, score: Column) -> DataFrame:
    """hits in the order of a second score, equal ones in their first order: new_rank."""
    return hits.withColumn("second", score).withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("second"), "rank")))


def highlight(query: Column, document: Column) -> Column:
    """Places (start, end) of the document's words that are words of the query, stop words left out: the document is split at its
    words, and their places are the running lengths of what lies between and of the words themselves."""
    word = r"[\p{L}\p{N}_]+"
    text, terms = F.coalesce(document, F.lit("")), words_of(F.coalesce(query, F.lit("")))
    pieces = F.arrays_zip(F.split(text, word, -1).alias("gap"), F.regexp_extract_all(text, F.lit(word), F.lit(0)).alias("word"))
    none = F.array().cast("array<struct<start: int, end: int>>")

    def step(so_far: Column, piece: Column) -> Column:
        start = so_far["at"] + F.length(piece["gap"])
        end = (start + F.coalesce(F.length(piece["word"]), F.lit(0))).cast("int")
        hit = F.array(F.struct(start.cast("int").alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.array_contains(terms, F.lower(piece["word"])), F.concat(so_far["spans"], hit)).otherwise(so_far["spans"]).alias("spans"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda x: x["spans"])


def search(queries: DataFrame, collections: dict[str, DataFrame], texts: DataFrame, k: int = TOP_K, reranked: bool = True) -> DataFrame:
    """(query_id, kind, id, score, rank, new_rank): the best k of the pool that pool_size() asks for, in the order of a second
    score over texts (id, text; queries (query_id, text, vector)) if reranked, else in the first order."""
    pool = retrieve(queries.select("query_id", "vector"), collections, pool_size(k, reranked))
    if not reranked:
        return pool.withColumn("new_rank", F.col("rank")).filter(F.col("new_rank") <= k)
    both = pool.join(texts.select("id", F.col("text").alias("_d")), "id", "left").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    scored = rerank(both, F.round(lexical_score(F.coalesce("_q", F.lit("")), F.coalesce("_d", F.lit(""))), 6))
    return scored.filter(F.col("new_rank") <= k).select("query_id", "kind", "id", "score", "rank", "new_rank")


def results(hits: DataFrame, corpus: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, rank, kind, id, score, title): titles of articles only."""
    return hits.filter(F.col("rank") <= k).join(corpus.select("id", "kind", "title"), ["id", "kind"], "left").select("query_id", "rank", "kind", "id", "score", F.when(F.col("kind") == "kb", F.col("title")).alias("title"))


def confidence_gate(queries: DataFrame, hits: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """(query_id, best, drafts): whether the best hit reaches least; no hit refuses."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", "best", (F.coalesce("best", F.lit(float("-inf"))) >= least).alias("drafts"))


def numbered_sources(hits: DataFrame, texts: DataFrame, n: int = SOURCES) -> DataFrame:
    return hits.filter(F.col("rank") <= n).join(texts.select("id", "text"), "id", "left").select("query_id", F.col("rank").alias("number"), "id", F.coalesce("text", F.lit("")).alias("text"))


def prompts(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, prompt): the issue and the numbered sources."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda s: F.concat(F.lit("["), s["number"].cast("string"), F.lit("] "), s["text"]))
    s = sources.groupBy("query_id").agg(F.array_join(lines, "\n").alias("s"))
    return queries.join(s, "query_id", "left").select("query_id", F.concat(F.lit("Issue: "), F.col("text"), F.lit("\nSources:\n"), F.coalesce("s", F.lit(""))).alias("prompt"))


def citations(reply: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(reply, F.lit(r"\[(\d+)\]")), lambda n: n.cast("int"))))


def call_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def spend(ledger: DataFrame, budget: float) -> DataFrame:
    return ledger.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spent")).withColumn("exhausted", F.col("spent") >= budget)


def cached_calls(calls: DataFrame, ledger: DataFrame) -> DataFrame:
    """calls (purpose, model, prompt_hash) that the ledger answers, with its response."""
    keys = ["purpose", "model", "prompt_hash"]
    return calls.join(ledger.select(*keys, "response").dropDuplicates(keys), keys)


def pending_calls(calls: DataFrame, ledger: DataFrame, budget_left: float) -> DataFrame:
    """Calls (purpose, model, prompt_hash, cost) that the ledger lacks, repeats once, in order of hash until their summed cost
    passes budget_left. Sums by the hash's first two digits, then one running sum inside each, keep it distributed."""
    keys = ["purpose", "model", "prompt_hash"]
    miss = calls.join(ledger.select(*keys), keys, "left_anti").dropDuplicates(keys).withColumn("b", F.substring("prompt_hash", 1, 2))
    sums = miss.groupBy("b").agg(F.sum("cost").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("b")) - F.col("all"))  # 256 rows at most
    run = F.sum("cost").over(Window.partitionBy("b").orderBy("prompt_hash", "purpose", "model").rowsBetween(Window.unboundedPreceding, 0))
    return miss.join(F.broadcast(sums), "b").withColumn("upto", F.round(F.col("before") + run, 9)).filter(F.col("upto") <= budget_left).select(*calls.columns)


def evaluate_retrieval(queries: DataFrame, corpus: DataFrame, truth: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row (hit_rate, n): share of queries of truth (query_id, relevant) with a relevant id among the first k."""
    ranked = top_k(queries, corpus, k).groupBy("query_id").agg(F.collect_set("id").alias("ids"))
    found = truth.join(ranked, "query_id", "left").groupBy("query_id").agg(F.max(F.coalesce(F.array_contains("ids", F.col("relevant")), F.lit(False)).cast("int")).alias("hit"))
    return found.agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("hit_rate"), F.count("*").alias("n"))
