"""Queries of entity spans and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as L
from ..operators import spans as H
from ..operators import tagger
from ..operators import sampling as S
from .q_sampling import SEEDED
from .q_text import NORMAL, URGENCY_SQL
from .tables import table


def rendered(spark, d):
    return H.render_templates(table(spark, d, "documents").select("doc_id"), "doc_id")


def _flat(df):
    return df.select(F.col("id").alias("doc_id"), F.explode("entities").alias("s")).select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.label").alias("label"))


def _gold(spark, d):
    return _flat(rendered(spark, d))


def _predicted(spark, d):
    g = _gold(spark, d).filter("doc_id % 4 <> 0")
    moved = g.select("doc_id", (F.col("start") + (F.col("doc_id") % 5 == 0).cast("int")).alias("start"), "end", F.when(F.col("doc_id") % 7 == 0, "DATE").otherwise(F.col("label")).alias("label"))
    return moved.unionByName(moved.filter("doc_id % 6 = 0"))


def _slots() -> str:
    def value(label: str) -> str:
        pool = ", ".join(f"'{x}'" for x in H.POOLS[label])
        return f"([{pool}])[({SEEDED.format(f'1-{label}', 'doc_id')} % {len(H.POOLS[label])} + 1)::INT]"

    templates = ", ".join(f"'{t}'" for t in H.TEMPLATES)
    fill = lambda s: "".join(["replace(" * len(H.POOLS), s, *[f", '{{{label}}}', v_{label})" for label in H.POOLS]])
    spans = " UNION ALL ".join(f"SELECT doc_id, '{x}' AS label, v_{x} AS surface, length({fill(f"split_part(t, '{{{x}}}', 1)")})::INT AS start FROM r WHERE contains(t, '{{{x}}}')" for x in H.POOLS)
    return f"""
WITH r AS (
  SELECT doc_id, ({SEEDED.format('1-template', 'doc_id')} % {len(H.TEMPLATES)} + 1)::INT AS template_id, ([{templates}])[({SEEDED.format('1-template', 'doc_id')} % {len(H.TEMPLATES)} + 1)::INT] AS t,
         {', '.join(f'{value(x)} AS v_{x}' for x in H.POOLS)} FROM documents),
e AS (SELECT doc_id AS id, template_id, {fill('t')} AS text FROM r),
g0 AS ({spans}),
g AS (SELECT doc_id, start, (start + length(surface))::INT AS "end", label, surface FROM g0),
p0 AS (SELECT doc_id, start + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS start, "end", CASE WHEN doc_id % 7 = 0 THEN 'DATE' ELSE label END AS label FROM g WHERE doc_id % 4 <> 0),
p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p0 WHERE doc_id % 6 = 0)
"""


def render_templates(spark, d):
    r = rendered(spark, d)
    return r.select("id", "template_id", "text", F.explode("entities").alias("s")).select("id", "template_id", "text", F.col("s.label").alias("label"), F.col("s.start").alias("start"), F.col("s.end").alias("stop"), F.col("s.text").alias("surface"))


def rule_spans(spark, d):
    """Spans that the rules find in rendered texts placed inside each document's own text."""
    docs = table(spark, d, "documents").join(rendered(spark, d).withColumnRenamed("text", "said"), F.col("doc_id") == F.col("id"))
    found = docs.select("doc_id", H.rule_spans(F.concat(F.col("said"), F.lit(". "), F.col("text"))).alias("entities"))
    return found.select("doc_id", F.explode("entities").alias("s")).select("doc_id", "s.label", "s.start", "s.end", "s.text")


def hybrid_spans(spark, d):
    r = rendered(spark, d)
    model = F.transform("entities", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["text"].alias("text"), F.lit(0.5).alias("score")))
    routed = r.select("id", H.route(F.col("entities"), model, {"DATE": "model", "PRODUCT": "model", "AMOUNT": "rules"}).alias("e"))
    return routed.select("id", F.explode("e").alias("s")).groupBy("s.label").agg(F.count("*").alias("n"), F.sum("s.score").alias("score"))


def _tokens(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "w")).select("doc_id", "pos", (F.col("pos") * 10).alias("start"), (F.col("pos") * 10 + F.least(F.length("w"), F.lit(9))).alias("end"), F.element_at(F.array(*[F.lit(x) for x in ("O", "B-A", "I-A", "B-B", "I-B")]), (F.length("w") % 5 + 1).cast("int")).alias("tag"), (F.length("w") % 4 / 4).alias("score"))


def decode_tags(spark, d):
    out = H.decode_tags(_tokens(spark, d))
    return out.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.round(F.sum("score"), 4).alias("score"))


def align_spans(spark, d):
    t = _tokens(spark, d).drop("tag", "score")
    s = t.filter("pos % 7 = 0").select("doc_id", (F.col("start") + 2).alias("start"), (F.col("start") + 25).alias("end"), F.when(F.col("pos") % 2 == 0, "DATE").otherwise("AMOUNT").alias("label"))
    return H.align_spans(t, s).groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


def bio_labels(spark, d):
    return table(spark, d, "labels").select(F.explode(F.array(*[F.lit(x) for x in H.bio_labels()])).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def _broken(spark, d):
    s = lambda s: F.struct(s["start"].alias("start"), (s["end"] + F.when(F.col("id") % 5 == 0, 3).otherwise(0)).alias("end"), F.when(F.col("id") % 7 == 0, "NAME").otherwise(s["label"]).alias("label"), s["text"].alias("text"), s["score"].alias("score"))
    return rendered(spark, d).withColumn("entities", F.transform("entities", s))


def span_violations(spark, d):
    return H.violations(_broken(spark, d))


def gold_checks(spark, d):
    r = rendered(spark, d)
    training = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return H.gold_checks(r.unionByName(r.join(training.filter("id % 10 = 0"), "id", "left_semi")), training, 1000)


def benchmark_leakage(spark, d):
    """Gold ids of the benchmark, by hash of normal text, that occur in documents."""
    from ..functions.text import content_hash

    gold = table(spark, d, "benchmark").select(content_hash(F.col("text")).alias("id"), F.array().cast(H.SPANS).alias("entities"))
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("t")).select(content_hash(F.col("t")).alias("id"))
    return H.gold_checks(gold, lines).filter("check <> 'few'").groupBy("check").agg(F.sum("n").alias("n"))


def shell_kinds(spark, d):
    from ..functions.text import clean_text

    r = rendered(spark, d).withColumn("entities", F.filter("entities", lambda s: s["label"] != "DATE"))
    return H.shell_kinds(r, clean_text(F.col("text")) == F.col("text")).groupBy("kind").agg(F.count("*").alias("n"))


def wrapped_spans(spark, d):
    text, spans = H.wrapped(F.lit("hi, "), F.col("text"), F.col("entities"), F.lit(" please"))
    w = rendered(spark, d).select("id", text.alias("text"), spans.alias("entities"))
    return w.select("id", F.explode("entities").alias("s"), "text").select("id", F.col("s.start").alias("start"), F.expr("substring(text, s.start + 1, s.end - s.start)").alias("surface"))


def paraphrases(spark, d):
    b, r = _broken(spark, d).select("id", F.col("entities").alias("after")), rendered(spark, d)
    return r.join(b, "id").select("id", H.paraphrase_kept(F.col("entities"), F.col("after")).alias("kept"))


def compose_dataset(spark, d):
    return H.compose(table(spark, d, "documents").select("doc_id"), "doc_id", {"template": 0.48, "shell": 0.15, "slot": 0.10, "splice": 0.12}).groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def gold_selection(spark, d):
    """Gold candidates among the rendered texts; every fifth has no proposal, and is a negative."""
    labels = F.when(F.col("id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.transform("entities", lambda s: s["label"]))
    return S.gold_selection(rendered(spark, d).select("id", labels.alias("labels")), "id", H.LABELS)


def proposal_union(spark, d):
    """Spans of the rules in rendered texts, and those of a second annotator with names of its own."""
    names = {"MONEY": "AMOUNT", "WHEN": "DATE"}
    second = F.transform("entities", lambda s: s.withField("label", F.when(s["label"] == "AMOUNT", "MONEY").when(s["label"] == "DATE", "WHEN").otherwise("OTHER")))
    p = rendered(spark, d).select("id", H.proposals(H.rule_spans(F.col("text")), second, names).alias("e"))
    return p.select("id", F.explode("e").alias("s")).select("id", "s.label", "s.start", F.col("s.end").alias("stop"), "s.text")


def _said(spark, d):
    """Rendered sentences in front of each document's own text: (id, text, entities)."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("own"))
    r = rendered(spark, d).select("id", F.col("text").alias("said"), "entities").join(docs, F.col("id") == F.col("doc_id"))
    return r.select("id", F.concat(F.col("said"), F.lit(". "), F.coalesce("own", F.lit(""))).alias("text"), "entities")


def _annotated(spark, d):
    """Both annotators' spans of all documents; the second is trained on all of them."""
    said = _said(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")  # texts may lie in few files; reading them is the work
    weights = tagger.train(said)
    return tagger.annotated(said.select("id", "text"), weights).withColumn("rules", H.rule_spans(F.col("text")))


def hybrid_tagged(spark, d):
    a = _annotated(spark, d).select("id", "truncated", H.route(F.col("rules"), F.col("model"), {"DATE": "model", "AMOUNT": "model", "PRODUCT": "rules"}).alias("e"))
    return a.select("id", "truncated", F.explode("e").alias("s")).select("id", "truncated", "s.label", "s.start", F.col("s.end").alias("stop"), "s.text")


def union_tagged(spark, d):
    a = _annotated(spark, d).select("id", H.proposals(F.col("rules"), F.col("model"), {x: x for x in H.LABELS}).alias("e"))
    return a.select("id", F.explode("e").alias("s")).select("id", "s.label", "s.start", F.col("s.end").alias("stop"), "s.text")


SHARES = {"template": 0.48, "shell": 0.15, "slot": 0.10, "splice": 0.12}


def compose_frames(spark, d):
    """Rendered texts, wrapped, substituted and spliced ones, and documents without spans, in exact shares."""
    r = rendered(spark, d)
    both = r.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("shell")), "id")
    wrapped = H.wrapped(F.concat("shell", F.lit(" ")), F.col("text"), F.col("entities"), F.lit(""))
    slot = H.substituted(F.col("text"), F.col("entities")[0], F.lit("NEW-1"))
    splice = H.spliced(F.lit("Thanks for that.  All fine! Bye."), F.col("text"), F.col("entities"), F.col("id"))
    frame = lambda df, made: df.select("id", made[0].alias("text"), made[1].alias("entities"))
    frames = {"template": r, "shell": frame(both, wrapped), "slot": frame(r, slot), "splice": frame(r, splice), "negative": both.select("id", F.col("shell").alias("text"), F.array().cast(H.SPANS).alias("entities"))}
    c = H.compose_frames(frames, SHARES, table(spark, d, "documents").count())
    sound = F.forall("entities", lambda s: F.substring("text", s["start"] + 1, s["end"] - s["start"]) == s["text"])
    return c.groupBy("source", "split").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("ids"), F.sum(F.size("entities")).alias("spans"), F.count_if(~sound).alias("broken"))


def import_checks(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    answers = docs.select(F.when(F.col("id") % 9 == 0, F.col("id") + 10_000_000).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return H.import_checks(answers.unionByName(answers.filter("id % 11 = 0")), docs)


def omissions(spark, d):
    r = rendered(spark, d)
    gold = r.withColumn("entities", F.when(F.col("id") % 3 == 0, F.array().cast(H.SPANS)).otherwise(F.col("entities")))
    return H.omissions(gold, r, table(spark, d, "labels").select(F.col("doc_id").alias("id")))


def proposal_counts(spark, d):
    return H.span_counts(rendered(spark, d))


def _judged(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), F.when(F.col("n_chars") > 1000, "good").when(F.col("n_chars") > 300, "bad").otherwise("short").alias("guess"))


CLASSES = ["good", "bad", "short", "none"]


def confusion(spark, d):
    return L.confusion(_judged(spark, d), CLASSES)


def class_f1(spark, d):
    f = L.class_f1(_judged(spark, d), CLASSES)
    return f.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def macro_f1(spark, d):
    return L.macro_f1(_judged(spark, d), CLASSES).select(F.round("macro_f1", 6).alias("macro_f1"))


def kappa(spark, d):
    return L.kappa(_judged(spark, d).toDF("a", "b")).withColumn("kappa", F.round("kappa", 6))


def urgency_agreement(spark, d):
    """Labels as seeds of urgency, against what the documents' own text gives."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ticket_id"), F.lit(0).alias("seq"), "text")
    seed = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 1, "low").otherwise("medium")
    seeds = table(spark, d, "labels").select(F.col("doc_id").alias("ticket_id"), F.lit(0).alias("seq"), seed.alias("label"))
    return L.urgency_agreement(docs, seeds).withColumn("kappa", F.round("kappa", 6))


def _rounded(df):
    return df.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def span_f1(spark, d):
    return _rounded(L.span_f1(_gold(spark, d), _predicted(spark, d)))


def partial_f1(spark, d):
    return _rounded(L.partial_f1(_gold(spark, d), _predicted(spark, d)))


def bootstrap_f1(spark, d):
    return L.bootstrap_f1(_gold(spark, d), _predicted(spark, d), table(spark, d, "documents"))


def span_errors(spark, d):
    texts = rendered(spark, d).select(F.col("id").alias("doc_id"), "text")
    return L.span_errors(_gold(spark, d), _predicted(spark, d), texts).withColumnRenamed("end", "stop")


def rouge(spark, d):
    from ..operators import threads
    from .tables import messages

    m = messages(spark, d)
    said = threads.dialogues(m).join(threads.first_customer_message(m), "ticket_id")
    r = L.rouge(said.select(F.col("ticket_id").alias("id"), F.col("opening").alias("reference"), threads.lead_k(F.col("dialogue"), 2).alias("summary")))
    return r.select("id", *[F.round(c, 6).alias(c) for c in ("rouge1", "rouge2", "rougeL")])


def judge_means(spark, d):
    e = table(spark, d, "events")
    reply = F.when(F.col("event_id") % 10 == 0, "no idea").otherwise(F.concat(F.lit("Faithfulness: "), (F.col("event_id") % 5 + 1).cast("string"), F.lit("\ncoverage = "), (F.col("user_id") % 5 + 1).cast("string")))
    s = L.judge_scores(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("model"), reply.alias("reply")))
    return L.judge_means(s, "click").select(*[F.round(c, 6).alias(c) for c in ("faithfulness", "coverage", "parsed_rate")], "n")


def recommend(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("user_id") % 2 == 0, "rules").otherwise("model").alias("variant"), F.col("event_type").alias("label"), (F.col("value") / 1000).alias("f1"))
    m = e.groupBy("variant", "label").agg(F.avg("f1").alias("f1"))
    return L.recommend(m, "rules", "model", 0.001).withColumn("delta", F.round("delta", 9))


def paired_hits(spark, d):
    e = table(spark, d, "events")
    return L.paired_hits(e.select(F.col("event_id").alias("query_id"), (F.col("value") > 50).alias("hit")), e.select(F.col("event_id").alias("query_id"), (F.col("user_id") % 3 == 0).alias("hit")))


def domain_gap(spark, d):
    e = table(spark, d, "events")
    m = e.select(F.col("event_type").alias("variant"), F.when(F.col("user_id") % 2 == 0, "real").otherwise("synthetic").alias("split"), "value")
    return L.domain_gap(m, "synthetic", "real").withColumn("gap", F.round("gap", 6))


G = _slots()
JUDGED = "WITH j AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN n_chars > 1000 THEN 'good' WHEN n_chars > 300 THEN 'bad' ELSE 'short' END AS guess FROM documents JOIN labels USING (doc_id)), c(label) AS (VALUES ('good'), ('bad'), ('short'), ('none')), f AS (SELECT label, (SELECT count(*) FROM j WHERE truth = label AND guess = label) AS tp, (SELECT count(*) FROM j WHERE truth <> label AND guess = label) AS fp, (SELECT count(*) FROM j WHERE truth = label AND guess <> label) AS fn FROM c), q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM f)\n"
TOKENS = "WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w, unnest(range(0, len(regexp_split_to_array(text, '\\s+')))) AS pos FROM documents), t AS (SELECT doc_id, pos, pos * 10 AS s, pos * 10 + least(length(w), 9) AS e, (['O', 'B-A', 'I-A', 'B-B', 'I-B'])[(length(w) % 5 + 1)::INT] AS tag, length(w) % 4 / 4 AS score FROM w)\n"
PRF = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"
BAD = ", b AS (SELECT doc_id AS id, start, \"end\" + CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END AS stop, CASE WHEN doc_id % 7 = 0 THEN 'NAME' ELSE label END AS label, surface FROM g), bb AS (SELECT b.*, text, max(stop) OVER (PARTITION BY b.id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b JOIN e ON b.id = e.id)\n"
MATCH = """, x AS (SELECT doc_id, start, "end", label, count(*) AS g FROM g GROUP BY ALL), y AS (SELECT doc_id, start, "end", label, count(*) AS p FROM p GROUP BY ALL),
m AS (SELECT label, least(coalesce(g, 0), coalesce(p, 0)) AS tp, coalesce(p, 0) - least(coalesce(g, 0), coalesce(p, 0)) AS fp, coalesce(g, 0) - least(coalesce(g, 0), coalesce(p, 0)) AS fn FROM x FULL JOIN y USING (doc_id, start, "end", label)),
xb AS (SELECT doc_id, start, "end", count(*) AS g FROM g GROUP BY ALL), yb AS (SELECT doc_id, start, "end", count(*) AS p FROM p GROUP BY ALL),
mb AS (SELECT least(coalesce(g, 0), coalesce(p, 0)) AS tp, coalesce(p, 0) - least(coalesce(g, 0), coalesce(p, 0)) AS fp, coalesce(g, 0) - least(coalesce(g, 0), coalesce(p, 0)) AS fn FROM xb FULL JOIN yb USING (doc_id, start, "end")),
each AS (SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM m GROUP BY label),
scored AS (SELECT label, tp, fp, fn, """ + PRF + """ FROM each), raw AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f FROM each)
"""
AGREED = f"WITH u AS ({URGENCY_SQL.replace(' UNION ALL SELECT page_id, html FROM pages', '')}), ab AS (SELECT u.label AS a, CASE WHEN toxic = 1 THEN 'high' WHEN quality = 1 THEN 'low' ELSE 'medium' END AS b FROM labels JOIN u ON u.id = doc_id), s AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS same FROM ab), e0 AS (SELECT sum(v.n * w.n) AS p FROM (SELECT a, count(*) AS n FROM ab GROUP BY a) v JOIN (SELECT b, count(*) AS n FROM ab GROUP BY b) w ON a = b) SELECT round((same / n - coalesce(p, 0) / (n * n)) / (1 - coalesce(p, 0) / (n * n)), 6) AS kappa, n FROM s, e0"
PART = ", ".join(f"{name} AS (SELECT doc_id, '{name}' AS source FROM documents QUALIFY row_number() OVER (ORDER BY {SEEDED.format('1-' + name, 'doc_id')}, doc_id) <= {quota})" for name, quota in ((x, f"(SELECT round_even(count(*) * {share}::DOUBLE, 0) FROM documents)") for x, share in SHARES.items()))
REST = "(SELECT count(*) - " + " - ".join(f"round_even(count(*) * {x}::DOUBLE, 0)" for x in SHARES.values()) + " FROM documents)"
COMPOSED = G + f", {PART}, negative AS (SELECT doc_id, 'negative' AS source FROM documents QUALIFY row_number() OVER (ORDER BY {SEEDED.format('1-negative', 'doc_id')}, doc_id) <= {REST}), u AS (" + " UNION ALL ".join(f"SELECT * FROM {x}" for x in [*SHARES, "negative"]) + f"), k AS (SELECT *, row_number() OVER (ORDER BY {SEEDED.format(1, 'source || chr(45) || doc_id')}, source || chr(45) || doc_id) AS k, count(*) OVER () AS n FROM u), c AS (SELECT doc_id, count(*) AS c FROM g GROUP BY doc_id) SELECT source, CASE WHEN k <= round_even(n * 0.70::DOUBLE, 0) THEN 'train' WHEN k <= round_even(n * (0.70::DOUBLE + 0.15::DOUBLE), 0) THEN 'val' ELSE 'test' END AS split, count(*) AS n, sum(doc_id)::BIGINT AS ids, sum(CASE source WHEN 'negative' THEN 0 WHEN 'slot' THEN 1 ELSE c END)::BIGINT AS spans, 0::BIGINT AS broken FROM k JOIN c USING (doc_id) GROUP BY ALL"
GOLD_SQL = G.rstrip() + f""",
x AS (SELECT id, {SEEDED.format(42, "id")} AS spot FROM e),
n AS (SELECT doc_id AS id, label, count(*) AS n, list_position([{", ".join(f"'{x}'" for x in H.LABELS)}], label) AS pos FROM g WHERE doc_id % 5 <> 0 GROUP BY doc_id, label),
u AS (SELECT id, pos, coalesce(sum(n) OVER (PARTITION BY label ORDER BY spot, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM n JOIN x USING (id)),
b AS (SELECT id, min(turn * 100 + pos) FILTER (turn < 30) AS turn FROM u GROUP BY id),
k AS (SELECT x.id, spot, b.turn, CASE WHEN b.id IS NOT NULL THEN CASE WHEN b.turn IS NULL THEN 2 ELSE 1 END
             WHEN row_number() OVER (PARTITION BY b.id IS NULL ORDER BY spot, x.id) <= 30 THEN 0 ELSE 3 END AS class FROM x LEFT JOIN b USING (id)),
c AS (SELECT id FROM k ORDER BY class, turn, spot, id LIMIT 200)
SELECT id, row_number() OVER (ORDER BY {SEEDED.format("42-blind", "id")}, id) <= 40 AS blind FROM c"""
QUERIES = {
    "render_templates": (render_templates, G + "SELECT id, template_id, text, label, start, \"end\" AS stop, surface FROM g JOIN e ON id = doc_id"),
    "rule_spans": (rule_spans, None),
    "hybrid_spans": (hybrid_spans, G + "SELECT label, count(*) AS n, sum(CASE WHEN label IN ('DATE', 'PRODUCT') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS score FROM g GROUP BY label"),
    "decode_tags": (decode_tags, TOKENS + ", l AS (SELECT *, CASE WHEN tag <> 'O' THEN substr(tag, 3) END AS label FROM t), o AS (SELECT *, CASE WHEN label IS NOT NULL AND (tag LIKE 'B-%' OR label IS DISTINCT FROM lag(label) OVER (PARTITION BY doc_id ORDER BY pos)) THEN 1 ELSE 0 END AS opens FROM l), n AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM o), z AS (SELECT doc_id, span, label, min(s) AS s, max(e) AS e, avg(score) AS score FROM n WHERE label IS NOT NULL GROUP BY ALL) SELECT doc_id, label, count(*) AS n, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends, round(sum(score), 4) AS score FROM z GROUP BY ALL"),
    "align_spans": (align_spans, TOKENS + ", q AS (SELECT doc_id, s + 2 AS a, s + 25 AS b, CASE WHEN pos % 2 = 0 THEN 'DATE' ELSE 'AMOUNT' END AS label FROM t WHERE pos % 7 = 0), h AS (SELECT t.doc_id, pos, CASE WHEN row_number() OVER (PARTITION BY t.doc_id, a, b, label ORDER BY pos) = 1 THEN 'B-' ELSE 'I-' END || label AS tag FROM t JOIN q ON t.doc_id = q.doc_id AND s < b AND a < e AND e > s), k AS (SELECT doc_id, pos, min(tag) AS tag FROM h GROUP BY ALL) SELECT t.doc_id, coalesce(k.tag, 'O') AS tag, count(*) AS n, sum(pos)::BIGINT AS places FROM t LEFT JOIN k USING (doc_id, pos) GROUP BY ALL"),
    "bio_labels": (bio_labels, "WITH t(tag) AS (VALUES " + ", ".join(f"('{x}')" for x in H.bio_labels()) + ") SELECT tag, (SELECT count(*) FROM labels) AS n FROM t"),
    "span_violations": (span_violations, G + BAD + "SELECT DISTINCT id, unnest(list_filter([CASE WHEN label NOT IN ('ORDER_ID', 'PRODUCT', 'DATE', 'AMOUNT', 'ACCOUNT_REF') THEN 'label' END, CASE WHEN start < 0 OR stop > length(text) OR start >= stop THEN 'bounds' END, CASE WHEN before > start THEN 'overlap' END, CASE WHEN substr(text, start + 1, stop - start) <> surface THEN 'surface' END], lambda x: x IS NOT NULL)) AS reason FROM bb"),
    "gold_checks": (gold_checks, G + ", q AS (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id % 10 = 0), fs AS (SELECT label, count(*) AS n FROM g JOIN q USING (doc_id) GROUP BY label) SELECT 'size' AS check, '' AS subject, count(*) AS n FROM q UNION ALL SELECT 'duplicate', doc_id::VARCHAR, count(*) FROM q GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT 'leaked', doc_id::VARCHAR, count(*) FROM q WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY doc_id UNION ALL SELECT 'few', label, n FROM fs WHERE n < 1000"),
    "benchmark_leakage": (benchmark_leakage, f"WITH g AS (SELECT sha1({NORMAL}) AS id FROM benchmark), l AS (SELECT DISTINCT sha1({NORMAL}) AS id FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents)), c AS (SELECT id, count(*) AS n FROM g GROUP BY id) SELECT 'size' AS check, count(*)::BIGINT AS n FROM g UNION ALL SELECT 'duplicate', sum(n)::BIGINT FROM c WHERE n > 1 HAVING count(*) > 0 UNION ALL SELECT 'leaked', sum(n)::BIGINT FROM c WHERE id IN (SELECT id FROM l) HAVING count(*) > 0"),
    "urgency_agreement": (urgency_agreement, AGREED),
    "gold_selection": (gold_selection, GOLD_SQL),
    "hybrid_tagged": (hybrid_tagged, None),
    "union_tagged": (union_tagged, None),
    "proposal_union": (proposal_union, None),
    "compose_frames": (compose_frames, COMPOSED),
    "shell_kinds": (shell_kinds, None),
    "wrapped_spans": (wrapped_spans, G + "SELECT doc_id AS id, start + 4 AS start, surface FROM g"),
    "paraphrases": (paraphrases, G + "SELECT DISTINCT doc_id AS id, doc_id % 7 <> 0 AS kept FROM g"),
    "compose_dataset": (compose_dataset, f"WITH k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY {SEEDED.format(1, 'doc_id')}, doc_id) - 1 AS k, (SELECT count(*) FROM documents) AS n FROM documents), c AS (SELECT id, CASE WHEN k < round_even(n * 0.48::DOUBLE, 0) THEN 'template' WHEN k < round_even(n * (0.48::DOUBLE + 0.15::DOUBLE), 0) THEN 'shell' WHEN k < round_even(n * (0.48::DOUBLE + 0.15::DOUBLE + 0.10::DOUBLE), 0) THEN 'slot' WHEN k < round_even(n * (0.48::DOUBLE + 0.15::DOUBLE + 0.10::DOUBLE + 0.12::DOUBLE), 0) THEN 'splice' ELSE 'negative' END AS kind FROM k) SELECT kind, count(*) AS n, sum(id)::BIGINT AS ids FROM c GROUP BY kind"),
    "import_checks": (import_checks, "WITH a0 AS (SELECT CASE WHEN doc_id % 9 = 0 THEN doc_id + 10000000 ELSE doc_id END AS id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents), a AS (SELECT * FROM a0 UNION ALL SELECT * FROM a0 WHERE id % 11 = 0), x AS (SELECT a.id, count(*) OVER (PARTITION BY a.id) AS n, o.doc_id AS known, a.text, o.text AS original FROM a LEFT JOIN documents o ON a.id = o.doc_id) SELECT DISTINCT id, 'unknown' AS reason FROM x WHERE known IS NULL UNION ALL SELECT DISTINCT id, 'repeated' FROM x WHERE n > 1 UNION ALL SELECT DISTINCT id, 'changed' FROM x WHERE known IS NOT NULL AND text IS DISTINCT FROM original"),
    "omissions": (omissions, G + "SELECT doc_id AS id, count(*)::INT AS n_predicted FROM g WHERE doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM labels) GROUP BY doc_id"),
    "proposal_counts": (proposal_counts, G + "SELECT label, count(*) AS n FROM g GROUP BY label"),
    "confusion": (confusion, JUDGED + "SELECT a.label AS truth, b.label AS guess, (SELECT count(*) FROM j WHERE truth = a.label AND guess = b.label) AS n FROM c a CROSS JOIN c b"),
    "class_f1": (class_f1, JUDGED + "SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM q"),
    "macro_f1": (macro_f1, JUDGED + "SELECT round(avg(f1), 6) AS macro_f1 FROM q"),
    "kappa": (kappa, JUDGED + ", s AS (SELECT count(*) AS n, count(*) FILTER (truth = guess) AS same FROM j), pe AS (SELECT sum((SELECT count(*) FROM j WHERE truth = label) * (SELECT count(*) FROM j WHERE guess = label)) AS p FROM c) SELECT round((same / n - p / (n * n)) / (1 - p / (n * n)), 6) AS kappa, n FROM s, pe"),
    "span_f1": (span_f1, G + MATCH + f"SELECT * FROM scored UNION ALL SELECT 'micro', tp, fp, fn, {PRF} FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM each) UNION ALL SELECT 'macro', (SELECT sum(tp) FROM each)::BIGINT, (SELECT sum(fp) FROM each)::BIGINT, (SELECT sum(fn) FROM each)::BIGINT, round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6) FROM raw UNION ALL SELECT 'boundary', tp, fp, fn, {PRF} FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM mb)"),
    "partial_f1": (partial_f1, None),
    "bootstrap_f1": (bootstrap_f1, None),
    "span_errors": (span_errors, G + ", x AS (SELECT doc_id, start, \"end\", label, row_number() OVER (PARTITION BY doc_id, start, \"end\", label) AS k FROM g), y AS (SELECT doc_id, start, \"end\", label, row_number() OVER (PARTITION BY doc_id, start, \"end\", label) AS k FROM p), z AS (SELECT y.*, 'FP' AS kind FROM y ANTI JOIN x USING (doc_id, start, \"end\", label, k) UNION ALL SELECT x.*, 'FN' FROM x ANTI JOIN y USING (doc_id, start, \"end\", label, k)) SELECT doc_id, start, \"end\" AS stop, label, kind, substr(text, start + 1, \"end\" - start) AS surface FROM z JOIN e ON id = doc_id"),
    "rouge": (rouge, None),
    "judge_means": (judge_means, "SELECT round(avg(CASE WHEN event_id % 10 = 0 THEN 3 ELSE event_id % 5 + 1 END), 6) AS faithfulness, round(avg(CASE WHEN event_id % 10 = 0 THEN 3 ELSE user_id % 5 + 1 END), 6) AS coverage, round(avg((event_id % 10 <> 0)::INT), 6) AS parsed_rate, count(*) AS n FROM events WHERE event_type = 'click'"),
    "recommend": (recommend, "WITH m AS (SELECT event_type AS label, avg(value / 1000) FILTER (user_id % 2 = 0) AS a, avg(value / 1000) FILTER (user_id % 2 <> 0) AS b FROM events GROUP BY ALL), x AS (SELECT label, coalesce(b, 0) - coalesce(a, 0) AS d FROM m) SELECT label, round(d, 9) AS delta, CASE WHEN d > 0.001::DOUBLE THEN 'win' WHEN d < -0.001::DOUBLE THEN 'loss' ELSE 'tie' END AS outcome, CASE WHEN d > 0.001::DOUBLE THEN 'model' ELSE 'rules' END AS use FROM x"),
    "paired_hits": (paired_hits, "SELECT value > 50 AS hit_a, user_id % 3 = 0 AS hit_b, count(*) AS n FROM events GROUP BY ALL"),
    "domain_gap": (domain_gap, "SELECT event_type AS variant, round(avg(value) FILTER (user_id % 2 <> 0) - avg(value) FILTER (user_id % 2 = 0), 6) AS gap FROM events GROUP BY ALL"),
}
