"""Entity spans: rule extraction, routing, tag tables, alignment, checks, template rendering and dataset composition.

A span is struct<start:int,end:int,label:string,text:string,score:double> with offsets in characters of its text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions.text import seeded
from ..sources.shared import give_back
from .sampling import exact_split, placed

SPAN = Y.StructType([Y.StructField("start", Y.IntegerType()), Y.StructField("end", Y.IntegerType()), Y.StructField("label", Y.StringType()), Y.StructField("text", Y.StringType()), Y.StructField("score", Y.DoubleType())])
SPANS = Y.ArrayType(SPAN)

# Labels, triggers, patterns and the product list, in order of precedence.
LABELS = ("ORDER_ID", "PRODUCT", "DATE", "AMOUNT", "ACCOUNT_REF")
EDGES = " \t\n\r.,!?;:)]}\"'"
ORDER_WORD = r"(?:order|confirmation|booking|tracking|invoice|rma|return)s?"
ACCOUNT_WORD = r"(?:account|membership|member|policy|case|reference|ref|subscriber|customer)s?"
AFTER_WORD = r"\s*(?:number|num|no\.?|#|id)?\s*[:#]?\s*"
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
COUNT = r"(?:\d+|a|an|one|two|three|four|five|six|seven|eight|nine|ten)"
RELATIVE = (
    "yesterday", "today", "tonight", "tomorrow", "this morning", "this afternoon", "this evening", "this week", "this month", "this year",
    "this weekend", "last night", "last week", "last month", "last year", "last monday", "last tuesday", "last wednesday", "last thursday",
    "last friday", "last saturday", "last sunday", "over the weekend", "next week",
)
PRODUCTS = (
    "iPhone 15 Pro Max", "iPhone 15 Pro", "iPhone 15", "iPhone 14 Pro Max", "iPhone 14 Pro", "iPhone 14", "iPhone 13 Pro Max", "iPhone 13 Pro",
    "iPhone 13", "iPhone 12 Pro Max", "iPhone 12 Pro", "iPhone 12", "iPhone SE", "iPad Pro", "iPad Air", "iPad Mini", "MacBook Pro",
    "MacBook Air", "Apple Watch Series 9", "Apple Watch Series 8", "Apple Watch SE", "AirPods Pro", "AirPods Max", "AirPods",
    "Samsung Galaxy S23", "Samsung Galaxy S22", "Samsung Galaxy S21", "Samsung Galaxy Note 20", "Samsung Galaxy Watch",
    "Samsung Galaxy Buds", "Galaxy Tab", "Kindle Paperwhite", "Kindle Fire", "Kindle", "PlayStation 5", "PlayStation 4", "PS5", "PS4",
    "Xbox Series X", "Xbox Series S", "Xbox Game Pass", "Xbox One", "Nintendo Switch", "Spotify Premium", "Spotify Family", "Prime Video",
    "Amazon Prime", "Netflix Premium", "Disney Plus", "Disney+", "Google Pixel 8", "Google Pixel 7", "Google Pixel", "Fitbit Charge",
    "Fitbit Versa", "Echo Dot", "Echo Show", "Amazon Echo", "Surface Pro", "Surface Laptop", "Delta Comfort+", "Comfort+",
    "Basic Economy", "Unlimited Plus", "Unlimited Plan", "Unlimited Data",
)


def _any(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


# Fixed values: (name, label, pattern); the span is the group v.
RULES = (
    ("order_trigger_numeric", "ORDER_ID", rf"\b(?i:{ORDER_WORD}){AFTER_WORD}(?P<v>\d{{4,12}})\b"),
    ("order_trigger_alnum", "ORDER_ID", rf"\b(?i:{ORDER_WORD}){AFTER_WORD}(?P<v>[A-Z]{{1,5}}-?\d{{3,}}(?:-[A-Z0-9]+)*)\b"),
    ("order_standalone_carrier_tracking", "ORDER_ID", r"\b(?P<v>1Z[A-Z0-9]{16})\b"),
    ("account_trigger_alnum", "ACCOUNT_REF", rf"\b(?i:{ACCOUNT_WORD}){AFTER_WORD}(?P<v>(?=[A-Za-z0-9-]*\d)[A-Za-z0-9][A-Za-z0-9-]{{3,}})\b"),
    ("account_card_last_four", "ACCOUNT_REF", r"\b(?i:ending\s+in|last\s+4\s+digits?(?:\s+(?:are|is))?:?)\s*(?P<v>\d{4})\b"),
    ("amount_symbol", "AMOUNT", r"(?P<v>[$£€]\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"),
    ("amount_code", "AMOUNT", r"\b(?P<v>(?:USD|EUR|GBP|CAD|AUD)\s?\d+(?:\.\d{2})?)\b"),
    ("amount_spelled", "AMOUNT", r"(?i)\b(?P<v>\d+(?:\.\d+)?\s+(?:dollars?|bucks|quid|pounds?(?:\s+sterling)?|euros?))\b"),
    ("amount_governed_bare_number", "AMOUNT", r"\b(?i:charged|refund(?:ed)?|billed|paid|cost(?:s)?|priced?|took)\s+(?:me\s+)?(?:of\s+)?\$?\s?(?P<v>\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\b"),
    ("date_numeric", "DATE", r"\b(?P<v>\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b"),
    ("date_month_day", "DATE", rf"\b(?P<v>(?i:{MONTH})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?)\b"),
    ("date_day_month", "DATE", rf"\b(?P<v>\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?(?i:{MONTH})\.?(?:,?\s+\d{{4}})?)\b"),
    ("date_month_year", "DATE", rf"\b(?P<v>(?i:{MONTH})\.?\s+\d{{4}})\b"),
    ("date_relative_duration", "DATE", rf"(?i)\b(?P<v>{COUNT}\s+(?:day|week|month|year)s?\s+(?:ago|back))\b"),
    ("date_relative_term", "DATE", rf"(?i)\b(?P<v>{_any(RELATIVE)})\b"),
    ("date_holiday", "DATE", r"(?i)\b(?P<v>christmas(?:\s+eve)?|black\s+friday|cyber\s+monday|thanksgiving|new\s+year'?s(?:\s+day)?)\b"),
    ("product_gazetteer", "PRODUCT", rf"(?i)\b(?P<v>{_any(PRODUCTS)})\b"),
)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    left = len(part) - len(part.lstrip(EDGES))
    core = len(part.strip(EDGES))
    return (start + left, start + left + core) if core else (start, start)


def resolve(spans: list[tuple]) -> list[tuple]:
    """Longest spans first, then those given first, as far as they do not overlap; in order of start."""
    kept: list[tuple] = []  # in order, apart from each other
    for s in sorted(spans, key=lambda s: s[0] - s[1]):
        i = bisect_left(kept, s)
        if (i == 0 or kept[i - 1][1] <= s[0]) and (i == len(kept) or s[1] <= kept[i][0]):
            kept.insert(i, s)
    return kept


#: Lower-case words with one of which each match of a rule begins, for rules that have such.
_ORDER, _ACCOUNT = ("order", "confirmation", "booking", "tracking", "invoice", "rma", "return"), ("account", "member", "policy", "case", "ref", "subscriber", "customer")
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
BEGIN = {
    "order_trigger_numeric": _ORDER, "order_trigger_alnum": _ORDER, "order_standalone_carrier_tracking": ("1z",), "account_trigger_alnum": _ACCOUNT, "account_card_last_four": ("ending", "last"),
    "amount_code": ("usd", "eur", "gbp", "cad", "aud"), "amount_governed_bare_number": ("charged", "refund", "billed", "paid", "cost", "price", "took"), "date_month_day": _MONTHS, "date_month_year": _MONTHS,
    "date_relative_term": RELATIVE, "date_holiday": ("christmas", "black", "cyber", "thanksgiving", "new"), "product_gazetteer": tuple(sorted({w.lower().split()[0] for w in PRODUCTS})),
}
#: Lower-case words of which each match of a rule holds one.
HOLD = {"amount_spelled": ("dollar", "buck", "quid", "pound", "euro"), "date_day_month": _MONTHS, "date_relative_duration": ("ago", "back")}
#: Beyond ASCII, what patterns that ignore case take for i, s and k; lower() does not.
FOLDED = re.compile("[\u0131\u0130\u017f\u212a]")


def matches(rule: str, pattern: re.Pattern, text: str, low: str | None):
    """pattern.finditer(text), but tried only where the lower-cased text low has a word with which a match begins."""
    if low is not None and rule in BEGIN:
        starts = set()
        for word in BEGIN[rule]:
            at = low.find(word)
            while at >= 0:
                starts.add(at)
                at = low.find(word, at + 1)
        end = 0
        for at in sorted(starts):
            if at >= end and (m := pattern.match(text, at)):
                end = m.end()
                yield m
    elif low is None or rule not in HOLD or any(word in low for word in HOLD[rule]):
        yield from pattern.finditer(text)


def found_spans(text: str, compiled: list[tuple[str, str, re.Pattern]]) -> list[tuple[int, int, str]]:
    """(start, end, label) of the rules (name, label, pattern) in a text, trimmed, overlaps resolved."""
    low = None if FOLDED.search(text) else text.lower()
    found = []
    for name, label, p in compiled:
        for m in matches(name, p, text, low):
            a, b = trimmed(text, *m.span("v"))
            if a < b:
                found.append((a, b, label))
    return resolve(found)


@F.pandas_udf(SPANS)
def rule_spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Spans of all rules in a text, trimmed, overlaps resolved."""
    compiled = [(name, label, re.compile(p)) for name, label, p in RULES]
    try:
        for text in batches:
            yield text.map(lambda t: [{"start": a, "end": b, "label": label, "text": t[a:b], "score": 1.0} for a, b, label in found_spans(t or "", compiled)])
    finally:
        give_back()


@F.pandas_udf(SPANS)
def resolved_spans(spans: pd.Series) -> pd.Series:
    """An array of candidate spans with overlaps resolved as in rule_spans()."""

    def one(rows) -> list[dict]:
        byplace = {}
        for s in rows if rows is not None else ():
            byplace.setdefault((s["start"], s["end"], s["label"]), s)
        return [dict(byplace[k]) for k in resolve(list(byplace))]

    return spans.map(one)


def proposals(rules: Column, second: Column, names: dict[str, str]) -> Column:
    """Spans of the rules and of a second annotator, whose labels names translates (others are left out), overlaps resolved."""
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    mapped = F.transform(F.filter(second, lambda s: s["label"].isin(*names)), lambda s: s.withField("label", known[s["label"]]))
    return resolved_spans(F.concat(rules, mapped.cast(SPANS)))


def route(rules: Column, model: Column, routing: dict[str, str]) -> Column:
    """Spans of each label from the side that routing names, `rules` or `model`; labels it lacks come from rules."""
    use_model = F.array(*[F.lit(k) for k, v in routing.items() if v == "model"], F.lit("\0"))
    return F.array_sort(F.concat(F.filter(rules, lambda s: ~F.array_contains(use_model, s["label"])), F.filter(model, lambda s: F.array_contains(use_model, s["label"]))))


def bio_labels(labels: tuple[str, ...] = LABELS) -> list[str]:
    return ["O", *(f"{p}-{x}" for x in sorted(labels) for p in "BI")]


def decode_tags(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, end, label, score) from (doc_id, pos, start, end, tag, score): B-, a change of label or an I- after O
    opens a span, O and nulls close it; the score is the mean of its tokens'."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    label = F.when(F.coalesce("tag", F.lit("O")) != "O", F.substring("tag", 3, 1 << 20))
    t = tokens.withColumn("label", label).withColumn("before", F.lag("label").over(order))
    opens = F.col("label").isNotNull() & (F.col("tag").startswith("B-") | ~F.col("label").eqNullSafe(F.col("before")))
    t = t.withColumn("span", F.sum(opens.cast("int")).over(order)).filter("label IS NOT NULL")
    return t.groupBy("doc_id", "span", "label").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score")).drop("span")


def align_spans(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """tokens (doc_id, pos, start, end) with the tag that spans (doc_id, start, end, label) give: B- on the first token that
    overlaps a span, I- on the others; tokens of no width are O."""
    columns, s = tokens.columns, spans.select(F.col("doc_id").alias("_doc"), F.col("start").alias("_s"), F.col("end").alias("_e"), "label")
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not joined to larger ones, which would spill when sorted
    dealt = tokens.repartition(parts, "doc_id").withColumn("_row", F.monotonically_increasing_id())  # every step deals by doc_id: one shuffle
    overlaps = (F.col("doc_id") == F.col("_doc")) & (F.col("end") > F.col("start")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end"))
    hit = dealt.join(s.withColumnRenamed("label", "_label").hint("shuffle_hash"), overlaps, "left")
    alone = F.when(F.col("_s").isNull(), F.col("_row"))  # tokens outside spans are no group
    first = F.col("pos") == F.min("pos").over(Window.partitionBy("doc_id", "_s", "_e", "_label", alone))
    place = Window.partitionBy("doc_id", "pos")
    tagged = hit.withColumn("_tag", F.concat(F.when(first, "B-").otherwise("I-"), "_label"))
    one = tagged.withColumn("_before", F.lag("_row").over(place.orderBy("_row"))).withColumn("tag", F.coalesce(F.min("_tag").over(place), F.lit("O")))
    return one.filter("_before IS NULL OR _before <> _row").select(*columns, "tag")


def violations(examples: DataFrame, fixed: Column | None = None) -> DataFrame:
    """(id, reason) for each broken rule of examples (id, text, entities)."""
    e = examples.select("id", "text", F.explode("entities").alias("s"))
    e = e.select("id", "text", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.label").alias("label"), F.col("s.text").alias("said"))
    before = F.max("end").over(Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    tests = {
        "label": ~F.col("label").isin(*LABELS), "bounds": (F.col("start") < 0) | (F.col("end") > F.length("text")) | (F.col("start") >= F.col("end")), "overlap": F.col("before") > F.col("start"),
        "surface": F.expr("substring(text, start + 1, end - start)") != F.col("said"), "padded": F.trim("said") != F.col("said"),
    }
    found = F.filter(F.array(*[F.when(c, name) for name, c in tests.items()]), lambda r: r.isNotNull())
    out = e.withColumn("before", before).select("id", F.explode(found).alias("reason"))
    if fixed is not None:
        out = out.unionByName(examples.filter(~fixed).select("id", F.lit("not clean").alias("reason")))
    return out.distinct()


def gold_checks(gold: DataFrame, training: DataFrame, floor: int = 5) -> DataFrame:
    """(check, subject, n): size, repeated ids, ids leaked from training, and labels with fewer than floor spans."""
    rows = gold.agg(F.count("*").alias("n")).select(F.lit("size").alias("check"), F.lit("").alias("subject"), "n")
    again = gold.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate").alias("check"), F.col("id").cast("string").alias("subject"), "n")
    leaked = gold.join(training.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n")).select(F.lit("leaked").alias("check"), F.col("id").cast("string").alias("subject"), "n")
    few = span_counts(gold).filter(F.col("n") < floor).select(F.lit("few").alias("check"), F.col("label").alias("subject"), "n")
    return rows.unionByName(again).unionByName(leaked).unionByName(few)


def span_counts(examples: DataFrame) -> DataFrame:
    return examples.select(F.explode("entities").alias("s")).groupBy(F.col("s.label").alias("label")).agg(F.count("*").alias("n"))


def shell_kinds(examples: DataFrame, fixed: Column) -> DataFrame:
    """(id, kind): `shell` without spans, `slot` with one, `dropped` with more or where the text is not clean."""
    n = F.size("entities")
    return examples.select("id", F.when(~fixed | (n > 1), "dropped").when(n == 1, "slot").otherwise("shell").alias("kind"))


# Templates of our own; the slots' names are the labels.
TEMPLATES = (
    "where is order {ORDER_ID} that you sent {DATE}", "you took {AMOUNT} for a {PRODUCT} twice", "please close account {ACCOUNT_REF} by {DATE}",
    "the {PRODUCT} from order {ORDER_ID} cost {AMOUNT}", "member {ACCOUNT_REF} here, no answer since {DATE}", "my {PRODUCT} broke {DATE}, refund {AMOUNT}",
)
POOLS = {
    "ORDER_ID": ("48213", "ORD-70415", "ZX4471-2093", "AMZ-118-6640275"), "PRODUCT": ("Kindle", "PS5", "MacBook Air", "Echo Dot"),
    "DATE": ("yesterday", "two weeks ago", "March 3", "12/04/2023"), "AMOUNT": ("$25.50", "EUR 40", "15 dollars", "£120"), "ACCOUNT_REF": ("ACC-402918", "REF55201", "CASE7734", "4471-0932"),
}


def render_templates(ids: DataFrame, ident: str, seed: int = 1) -> DataFrame:
    """(id, text, entities, template_id): for each id a template and slot values by seeded hash, offsets by a running cursor."""
    pick = lambda options, salt: F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(seeded(F.col(ident), f"{seed}-{salt}"), F.lit(len(options))) + 1).cast("int"))
    values = F.create_map(*[x for label, pool in POOLS.items() for x in (F.lit(label), pick(pool, label))])
    number = (F.pmod(seeded(F.col(ident), f"{seed}-template"), F.lit(len(TEMPLATES))) + 1).cast("int")
    t = ids.select(F.col(ident).alias("id"), number.alias("template_id"), values.alias("v"), F.element_at(F.array(*[F.lit(x) for x in TEMPLATES]), number).alias("t"))
    parts = t.withColumn("p", F.split("t", r"[{}]"))  # text and slot names in turn
    empty = F.struct(F.lit("").alias("text"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, i: Column) -> Column:
        piece = F.element_at(F.col("p"), i)
        value = F.when(i % 2 == 0, F.element_at(F.col("v"), piece)).otherwise(piece)
        at = F.length(acc["text"])
        span = F.struct(at.alias("start"), (at + F.length(value)).alias("end"), piece.alias("label"), value.alias("text"), F.lit(1.0).alias("score"))
        return F.struct(F.concat(acc["text"], value).alias("text"), F.when(i % 2 == 0, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).cast(SPANS).alias("spans"))

    made = F.aggregate(F.sequence(F.lit(1), F.size("p")), empty, step)
    return parts.withColumn("m", made).select("id", F.col("m.text").alias("text"), F.col("m.spans").alias("entities"), "template_id")


def wrapped(prefix: Column, text: Column, spans: Column, suffix: Column) -> tuple[Column, Column]:
    """Text with prefix and suffix, and its spans moved along."""
    n = F.length(prefix)
    return F.concat(prefix, text, suffix), F.transform(spans, lambda s: F.struct((s["start"] + n).alias("start"), (s["end"] + n).alias("end"), s["label"].alias("label"), s["text"].alias("text"), s["score"].alias("score")))


def _moved(spans: Column, n: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] + n).alias("start"), (s["end"] + n).alias("end"), s["label"].alias("label"), s["text"].alias("text"), s["score"].alias("score")))


def spliced(shell: Column, text: Column, spans: Column, pick: Column) -> tuple[Column, Column]:
    """text, as a sentence of its own, set into shell between two sentences, and its spans moved along; null where shell has
    only one. pick: a whole number that chooses the place."""
    gaps = F.regexp_extract_all(shell, F.lit(r"(?<=[.!?])(\s+)"))
    sentences = F.split(shell, r"(?<=[.!?])\s+")
    at = (F.pmod(pick, F.size(gaps)) + 1).cast("int")
    whole = F.zip_with(sentences, F.concat(gaps, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    before = F.concat(F.array_join(F.slice(whole, F.lit(1), at - 1), ""), F.element_at(sentences, at))
    after = F.array_join(F.slice(whole, at + 1, F.size(whole)), "")
    some = F.size(gaps) > 0
    return F.when(some, F.concat(before, F.lit(" "), text, F.lit(". "), after)), F.when(some, _moved(spans, F.length(before) + 1))


def substituted(text: Column, span: Column, value: Column) -> tuple[Column, Column]:
    """text with value in place of a span, and the span that it then has."""
    new = F.concat(F.substring(text, F.lit(1), span["start"]), value, F.substring(text, span["end"] + 1, F.length(text)))
    return new, F.array(F.struct(span["start"].alias("start"), (span["start"] + F.length(value)).alias("end"), span["label"].alias("label"), value.alias("text"), F.lit(1.0).alias("score")))


def paraphrase_kept(before: Column, after: Column) -> Column:
    """Whether two span arrays have the same multiset of label and surface."""
    pairs = lambda c: F.array_sort(F.transform(c, lambda s: F.struct(s["label"].alias("label"), s["text"].alias("text"))))
    return pairs(before) == pairs(after)


def compose(ids: DataFrame, ident: str, shares: dict[str, float], seed: int = 1) -> DataFrame:
    """(id, kind): exact shares of each kind at random by seed, the rest `negative`."""
    h = placed(ids.select(F.col(ident).alias("id")), "id", seed)
    kind, upto = F.lit("negative"), 1.0
    for name, share in reversed(list(shares.items())):
        upto = sum(v for k, v in list(shares.items())[: list(shares).index(name) + 1])
        kind = F.when(F.col("_p") <= F.bround(F.col("_all") * upto), name).otherwise(kind)
    return h.select("id", kind.alias("kind"))


def compose_frames(frames: dict[str, DataFrame], shares: dict[str, float], total: int, rest: str = "negative", seed: int = 1) -> DataFrame:
    """(id, text, entities, source, split): of frames (id, text, entities) each its share of total, at random by seed, what
    then lacks from the frame rest, and an exact 70/15/15 split of all. A frame that is too small gives all it has."""
    out = None
    quotas = {name: round(total * share) for name, share in shares.items()}
    quotas[rest] = total - sum(quotas.values())
    for name, quota in quotas.items():
        part = placed(frames[name].select("id", "text", "entities").filter("text IS NOT NULL"), "id", f"{seed}-{name}").filter(F.col("_p") <= quota)
        part = part.select(F.col("id").cast("string").alias("id"), "text", F.col("entities").cast(SPANS).alias("entities"), F.lit(name).alias("source"), F.concat_ws("-", F.lit(name), F.col("id").cast("string")).alias("_key"))
        out = part if out is None else out.unionByName(part)
    return exact_split(out, "_key", seed).drop("_key")


def import_checks(answers: DataFrame, originals: DataFrame) -> DataFrame:
    """(id, reason) for answers (id, text) whose id is unknown or repeated, or whose text is not the original's."""
    o = originals.select("id", F.col("text").alias("original")).withColumn("known", F.lit(True))
    a = answers.join(o, "id", "left").withColumn("n", F.count("*").over(Window.partitionBy("id")))
    tests = F.array(F.when(F.col("known").isNull(), "unknown"), F.when(F.col("n") > 1, "repeated"), F.when(F.col("known") & ~F.col("text").eqNullSafe(F.col("original")), "changed"))
    return a.select("id", F.explode(F.filter(tests, lambda r: r.isNotNull())).alias("reason")).distinct()


def omissions(gold: DataFrame, predicted: DataFrame, blind: DataFrame) -> DataFrame:
    """Blind ids whose gold has no span and whose prediction has one or more: (id, n_predicted)."""
    return gold.filter(F.size("entities") == 0).join(blind.select("id"), "id", "left_semi").select("id").join(predicted.select("id", F.size("entities").alias("n_predicted")), "id").filter("n_predicted > 0")
