"""Eligibility, capped shares, seeded samples, splits and quotas. Order at random is a hash of id and seed, so reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iso_week, seeded

CAP, SEED, CONFIDENCE = 0.08, 42, 0.70


def eligible(summary: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    """Rows of (lang, confidence) that are English, undetected, or not sure enough to be ruled out."""
    return summary.filter(F.col("lang").isNull() | (F.col("lang") == "en") | (F.col("confidence") < threshold))


def natural_shares(summary: DataFrame) -> DataFrame:
    """(brand, share) of messages by brand; a null brand is `__unknown__`."""
    by = summary.groupBy(F.coalesce("brand", F.lit("__unknown__")).alias("brand")).agg(F.sum("message_count").alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("all")))).select("brand", (F.col("n") / F.col("all")).alias("share"))  # one row


def capped_shares(shares: DataFrame, cap: float = CAP) -> DataFrame:
    """(brand, share, target): no target above cap, the excess going to the others in proportion until none is.

    In order of share, the k-th is capped if, with those before it at cap, its part of what is left would exceed cap. With
    cap times brands under 1 all are capped and targets sum below 1.
    """
    down = Window.orderBy(F.desc("share"), "brand")
    s = shares.withColumn("k", F.row_number().over(down) - 1).withColumn("suffix", F.sum("share").over(down.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.col("suffix") > 0
    s = s.withColumn("capped", fits & (F.col("share") * (1 - cap * F.col("k")) / F.col("suffix") > cap + 1e-12))
    one = s.agg(F.count_if("capped").alias("c"), F.coalesce(F.max(F.when(~F.col("capped"), F.col("suffix"))), F.lit(0.0)).alias("rest"), F.count("*").alias("n"), F.sum("share").alias("sum"))
    s = s.crossJoin(F.broadcast(one))  # one row
    even = F.least(1 / F.col("n"), F.lit(cap))
    target = F.when(F.col("sum") == 0, even).when(F.col("capped"), cap).otherwise(F.col("share") * (1 - cap * F.col("c")) / F.col("rest"))
    return s.select("brand", "share", target.alias("target"))


def weekly_pick(summary: DataFrame, targets: DataFrame, total: int, seed: int = SEED) -> DataFrame:
    """Conversations (root, brand, start_time, message_count): per brand, weeks in turn give one at random each until the
    brand's running count of messages reaches its target share of total."""
    s = summary.withColumn("brand", F.coalesce("brand", F.lit("__unknown__"))).withColumn("week", iso_week(F.col("start_time")))
    s = placed(s, "root", seed, "brand", "week").withColumnRenamed("_p", "round").drop("_all")
    s = sum_before(s, "message_count", "brand", "round", "week")
    return s.join(targets.select("brand", "target"), "brand").filter(F.col("_sum") < F.bround(F.col("target") * total)).select("root", "brand", "week", "message_count")


def sum_before(rows: DataFrame, value: str, group: str, major: str, minor: str) -> DataFrame:
    """rows with _sum, the sum of value over the rows of the same group that stand before, by the integer major and then minor.

    Three levels of sums: over blocks of 1,024 majors, over the majors of a block, over the rows of a major. No task sorts a whole
    group, only the rows of one major or 1,024 sums.
    """
    v = F.coalesce(F.col(value), F.lit(0))
    each = rows.groupBy(F.col(group).alias("_g"), F.col(major).alias("_m")).agg(F.sum(v).alias("_v")).withColumn("_k", F.shiftright("_m", 10))
    block = each.groupBy("_g", "_k").agg(F.sum("_v").alias("_all"))
    block = block.withColumn("_before", F.sum("_all").over(Window.partitionBy("_g").orderBy("_k")) - F.col("_all")).drop("_all")
    each = each.join(block, ["_g", "_k"]).withColumn("_before", F.col("_before") + F.sum("_v").over(Window.partitionBy("_g", "_k").orderBy("_m")) - F.col("_v"))
    near = Window.partitionBy(group, major).orderBy(minor).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(each.select("_g", "_m", "_before"), (F.col(group) == F.col("_g")) & (F.col(major) == F.col("_m")))
    return out.withColumn("_sum", F.col("_before") + F.coalesce(F.sum(v).over(near), F.lit(0))).select(*rows.columns, "_sum")


def placed(rows: DataFrame, ident: str, seed: int | str, *by: str) -> DataFrame:
    """rows with _p, the 1-based place at random by seed among all rows or those of equal by (nulls too), and _all, their number.

    Only counts of 1,024 buckets a group cross tasks; a group's rows are ranked bucket by bucket, so a large group is many tasks' work.
    """
    h = rows.withColumn("_h", seeded(F.col(ident), seed)).withColumn("_b", F.shiftright("_h", 50))
    names = [f"_by{i}" for i in range(len(by))]
    counts = h.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*names).orderBy("_c")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(*names))).drop("_n")
    same = F.col("_b") == F.col("_c")
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    h = h.join(counts if by else F.broadcast(counts), same)  # 1,024 rows at most without groups
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", ident))
    return h.withColumn("_p", place).select(*rows.columns, "_p", "_all")


def stratified_split(rows: DataFrame, label: str, ident: str, seed: int = SEED, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """rows with split: exact shares within each label, at random by seed."""
    return _split(placed(rows, ident, seed, label), train, val)


def exact_split(rows: DataFrame, ident: str, seed: int = SEED, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """rows with split: exact shares of all rows, at random by seed."""
    return _split(placed(rows, ident, seed), train, val)


def _split(p: DataFrame, train: float, val: float) -> DataFrame:
    cut1, cut2 = F.bround(F.col("_all") * train), F.bround(F.col("_all") * (train + val))
    return p.withColumn("split", F.when(F.col("_p") <= cut1, "train").when(F.col("_p") <= cut2, "val").otherwise("test")).drop("_p", "_all")


def sample(rows: DataFrame, ident: str, n: int, seed: int = SEED) -> DataFrame:
    return rows.orderBy(seeded(F.col(ident), seed), ident).limit(n)


def sample_excluding(rows: DataFrame, done: DataFrame, ident: str, n: int, seed: int = SEED) -> DataFrame:
    return sample(rows.join(done.select(ident).distinct(), ident, "left_anti"), ident, n, seed)


def pools(rows: DataFrame, ident: str, gold: float = 0.10, seed: int = SEED) -> DataFrame:
    """rows with pool: a tenth `gold`, the others `shell`, by one global order that only bucket counts cross tasks for."""
    return placed(rows, ident, seed).withColumn("pool", F.when(F.col("_p") <= F.bround(F.col("_all") * gold), "gold").otherwise("shell")).drop("_p", "_all")


def first_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_k") <= n).drop("_k")


def quota_sample(tagged: DataFrame, quotas: dict[str, int], ident: str, seed: int = SEED) -> DataFrame:
    """(ident, quota): each quota in turn takes its number at random from its rows (ident, quota) not taken before."""
    taken = None
    for quota, n in quotas.items():
        rows = tagged.filter(F.col("quota") == quota).select(ident).distinct()
        if taken is not None:
            rows = rows.join(taken.select(ident), ident, "left_anti")
        got = sample(rows, ident, n, seed).withColumn("quota", F.lit(quota))
        taken = got if taken is None else taken.unionByName(got)
    return taken


def label_quota(examples: DataFrame, ident: str, per_label: int, negatives: int, blind: int, seed: int = SEED) -> DataFrame:
    """(ident, blind): of (ident, labels) the first per_label by random order for each label, negatives without labels, and a
    blind subset of all."""
    labelled = examples.filter(F.size("labels") > 0).select(ident, F.explode(F.array_distinct("labels")).alias("label"))
    ranked = labelled.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(seeded(F.col(ident), seed), ident))).filter(F.col("k") <= per_label)
    none = sample(examples.filter(F.size("labels") == 0).select(ident), ident, negatives, seed)
    chosen = ranked.select(ident).distinct().unionByName(none)
    hidden = sample(chosen, ident, blind, f"{seed}-blind").withColumn("blind", F.lit(True))
    return chosen.join(hidden, ident, "left").withColumn("blind", F.coalesce("blind", F.lit(False)))


def gold_selection(candidates: DataFrame, ident: str, labels: tuple[str, ...], total: int = 200, per_label: int = 30, negatives: float = 0.15, blind: int = 40, seed: int = SEED) -> DataFrame:
    """(ident, blind): total of the candidates (ident, labels: the label of each proposed span, repeats included).

    Rows stand at random by seed. A row's turn for a label is the number of that label's spans in the rows before it; the label
    needs the row while that is under per_label. Chosen are a share of negatives, without spans; then needed rows by their least
    turn, so that labels fill evenly, ties in order of labels; then other rows with spans; then without. So each label has per_label
    spans, or all that it has, if total leaves room. A blind part of the chosen is marked. Each kind of row is first cut to its
    first `total`, of which no more can be chosen, so that turns are counted over a number of rows that does not grow.
    """
    rows = candidates.select(F.col(ident).alias("id"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), seeded(F.col(ident), seed).alias("spot"))
    kind = F.array(F.when(F.size("labels") > 0, " with").otherwise(" without"))
    kinds = rows.withColumn("kind", F.explode(F.concat(kind, F.array_distinct(F.filter("labels", lambda x: x.isin(*labels))))))
    own = Window.partitionBy("kind").orderBy("spot", "id")
    first = kinds.withColumn("k", F.row_number().over(own)).filter(F.col("k") <= total)
    spans = F.size(F.filter("labels", lambda x: x == F.col("kind")))
    turned = first.withColumn("turn", F.coalesce(F.sum(spans).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.when(F.col("kind") == " without", F.struct(F.when(F.col("k") <= min(round(total * negatives), total), 0).otherwise(3).alias("class"), F.lit(0).cast("long").alias("turn"), F.lit(0).cast("long").alias("at")))
    rank = rank.when(F.col("kind") == " with", F.struct(F.lit(2).alias("class"), F.lit(0).cast("long").alias("turn"), F.lit(0).cast("long").alias("at")))
    need = F.when(F.col("turn") < per_label, F.col("turn"))
    rank = rank.when(need.isNotNull(), F.struct(F.lit(1).alias("class"), need.cast("long").alias("turn"), F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("kind")).cast("long").alias("at")))
    best = turned.groupBy("id", "spot").agg(F.min(rank).alias("rank")).filter("rank IS NOT NULL")  # null: only past the cuts
    chosen = best.orderBy("rank", "spot", "id").limit(total).select("id")
    hidden = sample(chosen, "id", blind, f"{seed}-blind").withColumn("blind", F.lit(True))
    return chosen.join(hidden, "id", "left").select(F.col("id").alias(ident), F.coalesce("blind", F.lit(False)).alias("blind"))
