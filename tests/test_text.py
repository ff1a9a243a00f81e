import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as T


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("see https://a.b/c?d=1. Then", "see <URL>. Then"),
        ("(www.x.org/y)", "(<URL>)"),
        ("mail a.b+c@d-e.co now", "mail <EMAIL> now"),
        ("hi @bob_1!", "hi <USER>!"),
        ("call +1 (555) 123-4567 or 555.123.4567", "call <PHONE> or <PHONE>"),
        ("id 15551234567", "id 15551234567"),
        ("", ""),
    ],
)
def test_mask_entities(spark, given, expected):
    assert one(spark, T.mask_entities, given) == expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("a<br/>b <b>c</b>", "a\nb c"),
        ("x &amp; y", "x & y"),
        ("soooooo good!!!!!!", "sooo good!!!"),
        ("fine  thing \n\n\n\nend", "fine thing \n\nend"),
        ("done\nThanks,\nAnn", "done"),
        ("ok ^AB", "ok"),
        ("ok\nSent from my iPhone", "ok"),
        ("yes On Monday Bob wrote:\n> no", "yes"),
        ("nice :-) <3", "nice <EMOJI:slightly_smiling_face> <EMOJI:red_heart>"),
        ("wow \U0001f600", "wow <EMOJI:grinning_face>"),
        ("cafÃ©", "café"),
        ("ﬁne​ text", "fine text"),
    ],
)
def test_clean_text(spark, given, expected):
    assert one(spark, T.clean_text, given) == expected
    assert one(spark, T.clean_text, expected) == expected


def test_null_text_stays_null(spark):
    assert one(spark, T.clean_text, None) is None


def test_keys(spark):
    made = one(spark, lambda c: T.deterministic_id("ticket", c), "é-12")
    ns = uuid.UUID(T.NAMESPACE)
    assert made == str(uuid.uuid5(ns, "ticket:é-12"))
    assert one(spark, T.content_hash, " Hello <URL>  WORLD ") == hashlib.sha1(b"hello world").hexdigest()


@pytest.mark.parametrize(("given", "label"), [("it is broken", "medium"), ("THIS IS FRAUD", "high"), ("hello there", "low"), ("", "low"), ("my 3rd day waiting", "high")])
def test_urgency(spark, given, label):
    assert one(spark, lambda c: T.urgency_label(T.urgency_score(c)), given) == label


def test_time_and_ids(spark):
    assert str(one(spark, T.parse_timestamp, "Tue Oct 31 20:00:00 +0000 2017")) == "2017-10-31 20:00:00"
    assert one(spark, T.parse_timestamp, "soon") is None
    assert one(spark, T.parse_ids, "1, 2,,3 ") == ["1", "2", "3"]
    assert one(spark, T.parse_ids, None) == []


def test_language_vote(spark):
    assert one(spark, T.language_vote, "the cat and the dog in it")["lang"] == "en"
    blank = one(spark, T.language_vote, "  ")
    assert blank["lang"] is None and blank["confidence"] == 0.0


def test_urgency_lowers_a_text_once_and_keeps_each_pattern(spark):
    rows = spark.createDataFrame([("x",)], "t string").select(T.urgency_score(F.col("t")).alias("s"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    said = ["someone logged", "rip off", "2 nd day", "contact my mp", "frustrating", "please fix", "can't", "3 dms", "five days", "still no response", "better business bureau", "again", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in said], "t string").select(T.urgency_score(F.col("t"))).collect()]
    assert got == [2.0, 2.0, 2.0, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0, 4.0, 2.0, 1.0, None]
