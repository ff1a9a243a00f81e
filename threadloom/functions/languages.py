"""Language detection by profiles of character trigrams, counted from labelled text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The languages that are told apart.
CODES = ("ar", "de", "en", "es", "fr", "hi", "id", "it", "ja", "nl", "pt", "tr")
KEPT = 2_000
UNSEEN = 0.5
MICRO = 1_000_000


def trigrams(c: Column) -> Column:
    """All runs of three characters of the text's lower-cased letters and marks, a space before, after and between its words."""
    letters = F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{M}]+", " ")))
    return F.regexp_extract_all(F.concat(F.lit(" "), letters, F.lit(" ")), F.lit(r"(?=([\p{L}\p{M} ]{3}))"), F.lit(1))


def language_profiles(labelled: DataFrame, kept: int = KEPT) -> DataFrame:
    """(gram, w_ and each code): what a trigram adds to the log-likelihood of a language, in whole millionths, so that sums
    are the same in any order.

    labelled: (text, lang); other languages than CODES are left out. Counts are of all texts; the grams are each language's kept most
    frequent ones (ties: smallest), 24,000 of all languages at most, so that the table can be broadcast. Columns of languages without
    text are null. Repeated rows count each time; an empty table gives no grams.
    """
    counts = labelled.filter(F.col("lang").isin(*CODES)).select("lang", F.explode(trigrams(F.col("text"))).alias("gram")).groupBy("lang", "gram").count()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "gram"))
    known = counts.withColumn("first", first).filter(F.col("first") <= kept).select("gram").distinct()
    wide = counts.join(F.broadcast(known), "gram").groupBy("gram").pivot("lang", list(CODES)).agg(F.sum("count"))
    totals = counts.agg(*[F.sum(F.when(F.col("lang") == x, F.col("count"))).alias(f"all_{x}") for x in CODES], F.count_distinct("gram").alias("grams"))

    def weight(x: str) -> Column:
        share = (F.coalesce(F.col(x), F.lit(0)) + UNSEEN) / (F.col(f"all_{x}") + UNSEEN * F.col("grams"))
        return F.round(F.log(share) * MICRO).cast("long").alias(f"w_{x}")

    return wide.crossJoin(F.broadcast(totals)).select("gram", *[weight(x) for x in CODES])  # totals are one row


def detected(texts: DataFrame, profiles: DataFrame, key: str = "id") -> DataFrame:
    """(key, lang, confidence): the likeliest language of each text and its share of all languages' likelihoods, where each is as
    likely beforehand; equal ones go to the first code.

    Null, blank and letterless texts, and those without a known gram: null and 0. Rows of one key are one text. Grams never leave
    their task: it adds them up before the shuffle, whatever the length of the text.
    """
    grams = texts.select(key, F.explode_outer(trigrams(F.col("text"))).alias("gram"))
    sums = grams.join(F.broadcast(profiles), "gram", "left").groupBy(key).agg(*[F.sum(f"w_{x}").alias(f"w_{x}") for x in CODES])
    best = F.greatest(*[F.col(f"w_{x}") for x in CODES])
    lang = F.coalesce(*[F.when(F.col(f"w_{x}") == best, F.lit(x)) for x in CODES])
    shares = sum((F.coalesce(F.exp((F.col(f"w_{x}") - best) / MICRO), F.lit(0.0)) for x in CODES), F.lit(0.0))
    return sums.select(key, lang.alias("lang"), F.when(best.isNull(), 0.0).otherwise(1.0 / shares).alias("confidence"))
