"""Text columns: cleaning, masking, normal forms, urgency signals. Built-in functions, but for three Arrow steps."""

from __future__ import annotations

import functools
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .encoding import repair

# Mask tokens, patterns and word lists whose results are compared with published ones.
MASK_TOKENS = ("<URL>", "<USER>", "<EMAIL>", "<PHONE>")
BREAK = r"(?i)<br\s*/?>"
TAG = r"<(?!/?(?:URL|USER|EMAIL|PHONE|EMOJI:))[^>]+>"
SIGNATURES = (
    r"(?isU)\bOn .{0,80}?wrote:.*$",
    r"(?i)\n\s*(?:Thanks|Thank you|Regards|Best|Best regards|Sincerely)[,.]?\s*\n[^\n]*$",
    r"(?i)\s*Sent from my \w+\s*$",
    r"\s*\^\s*-?\s*[A-Za-z][\w'-]*\s*$",
)
ZERO_WIDTH = "[​‌‍⁠﻿]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
EMOTICONS = {
    ":-)": "slightly_smiling_face", ":)": "slightly_smiling_face", ":-(": "frowning_face", ":(": "frowning_face",
    ":-D": "grinning_face", ":D": "grinning_face", ";-)": "winking_face", ";)": "winking_face", ":'(": "crying_face", "<3": "red_heart",
}
URL = r"""(?i)(?:https?://(?=[^\s<>"'])|www(?=\.[^\s<>"']))[^\s<>"']*?([.,!?;:)\]}]*)(?=[\s<>"']|$)"""
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[A-Za-z]{2,}"
HANDLE = r"(?U)(?<![\w@])@[A-Za-z0-9_]{1,15}\b"
PHONE = r"(?<!\d)(?:\+?\d{1,3}[-.\s])?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}(?!\d)"
#: The patterns of the registered SQL, whose engine folds case beyond ASCII, takes six characters less one as white space (no vertical
#: tab) and an end of text as the very end. A URL goes with the punctuation that ends it; a phone number needs a character of its own on both sides.
BLANK = r"\t\n\f\r "
SQL_URL = rf"""(?iu)(?:https?://|www\.)[^{BLANK}<>"']+"""
SQL_EMAIL = r"(?:\G|(?<![\p{L}\p{N}_.+-]))[\p{L}\p{N}_.+-]++@[\p{L}\p{N}_-]++\.[A-Za-z]{2,}"
SQL_HANDLE = r"(?<![\p{L}\p{N}_@])@[A-Za-z0-9_]{1,15}(?![A-Za-z0-9_])"
SQL_PHONE = rf"(^|[^0-9])(?:\+?[0-9]{{1,3}}[-.{BLANK}])?\(?[0-9]{{3}}\)?[-.{BLANK}][0-9]{{3}}[-.{BLANK}][0-9]{{4}}(\z|[^0-9])"
SQL_SIGNATURES = (
    (r"(?is)(^|[^\p{L}\p{N}_])On .{0,80}?wrote:.*\z", "$1"),
    (rf"(?iu)\n[{BLANK}]*+(?:Thanks|Thank you|Regards|Best|Best regards|Sincerely)[,.]?[{BLANK}]*\n[^\n]*\z", ""),
    (rf"(?iu)[{BLANK}]*+Sent from my [A-Za-z0-9_]+[{BLANK}]*\z", ""),
    (rf"[{BLANK}]*+\^[{BLANK}]*-?[{BLANK}]*[A-Za-z][A-Za-z0-9_'-]*[{BLANK}]*\z", ""),
    (rf"(?<![{BLANK}])[{BLANK}]+\z", ""),
)
HIGH_URGENCY = (
    r"\blawyer\b", r"\blawsuit\b", r"\bsue\b", r"\battorney\b", r"\blegal action\b", r"\bbbb\b", r"\bbetter business bureau\b",
    r"\bchargeback\b", r"\bfraud\b", r"\bscam\b", r"\bstolen\b", r"\bstealing\b", r"\bhacked\b", r"\bunauthorized\b",
    r"\b(someone|somebody)\s+(changed|accessed|hacked|logged)\b", r"\bunacceptable\b", r"\bdisgusting\b", r"\bhorrible\b",
    r"\bterrible\b", r"\bworst\b", r"\brip.?off\b", r"\bpathetic\b", r"\bdisgrace\b", r"\d+\s*(st|nd|rd|th)\s+(day|time)\b",
    r"\bstill no response\b", r"\bno response\b", r"\bcontact (my|your) (mp|lawyer|attorney)\b",
)
MEDIUM_URGENCY = (
    r"\bfrustrat\w*\b", r"\bannoy\w*\b", r"\bdisappoint\w*\b", r"\bridiculous\b", r"\bplease help\b",
    r"\bplease (respond|fix|reply)\b", r"\bstill waiting\b", r"\bany update\b", r"\bagain\b", r"\bnot working\b", r"\bbroken\b",
    r"\boutage\b", r"\bcan.?t\b", r"\bcannot\b", r"\bdamn\b", r"\b(two|three|four|five|six|\d+)\s+(times|dms|emails|messages|days)\b",
)
#: What a text has if a pattern of urgency fits it: one of the words. Searching for words is many times faster than for patterns.
URGENCY_WORDS = {
    r"\b(someone|somebody)\s+(changed|accessed|hacked|logged)\b": ("someone", "somebody"), r"\brip.?off\b": ("rip",), r"\d+\s*(st|nd|rd|th)\s+(day|time)\b": ("day", "time"),
    r"\bcontact (my|your) (mp|lawyer|attorney)\b": ("contact ",), r"\bfrustrat\w*\b": ("frustrat",), r"\bannoy\w*\b": ("annoy",), r"\bdisappoint\w*\b": ("disappoint",),
    r"\bplease (respond|fix|reply)\b": ("please respond", "please fix", "please reply"), r"\bcan.?t\b": ("can",), r"\b(two|three|four|five|six|\d+)\s+(times|dms|emails|messages|days)\b": ("times", "dms", "emails", "messages", "days"),
}
HIGH_FROM, MEDIUM_FROM = 2.0, 0.7
#: Frequent function words of each language that the vote knows.
STOP_VOTE = {
    "en": "the and of to in is that it for was with this", "es": "el la de que y en los del las por con una",
    "fr": "le la les des et en un une du est pour dans", "de": "der die und das ist nicht ein eine mit von zu den",
    "pt": "o a os as de que e do da em um uma", "it": "il di che e la per un una sono con non del",
    "nl": "de het een en van ik dat niet is op te met", "id": "yang dan di itu dengan untuk tidak ini dari dalam",
    "tr": "ve bir bu da de ne gibi daha çok için", "ja": "の に は を た が で", "ar": "في من على أن إلى عن", "hi": "के का की में है से को",
}

_EMOJI = re.compile("[\U0001f300-\U0001faff☀-➿⬀-⯿]️?")


def _emoji_name(match: re.Match) -> str:
    name = unicodedata.name(match.group(0)[0], "")
    return f"<EMOJI:{name.lower().replace(' ', '_').replace('-', '_')}>" if name else match.group(0)


@F.pandas_udf(StringType())
def repaired(text: pd.Series) -> pd.Series:
    """Mojibake repaired and HTML entities replaced."""
    return text.map(lambda t: html.unescape(repair(t)), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def emoji_named(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _EMOJI.sub(_emoji_name, t), na_action="ignore")


def strip_html(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, BREAK, "\n"), TAG, "")


def strip_signatures(c: Column) -> Column:
    for p in SIGNATURES:
        c = F.regexp_replace(c, p, "")
    return F.regexp_replace(c, r"\s+$", "")


def strip_signatures_sql(c: Column) -> Column:
    """strip_signatures() as the registered SQL has it."""
    for p, kept in SQL_SIGNATURES:
        c = F.regexp_replace(c, p, kept)
    return c


def normalize_unicode(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.regexp_replace(nfkc(c), ZERO_WIDTH, ""), CONTROL, ""), " ", " ")


def mask_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, "<URL>$1")


def mask_entities(c: Column) -> Column:
    """URLs, then emails, then handles, then phone numbers, so that no token is masked twice."""
    c = F.regexp_replace(mask_urls(c), EMAIL, "<EMAIL>")
    return F.regexp_replace(F.regexp_replace(c, HANDLE, "<USER>"), PHONE, "<PHONE>")


def mask_entities_sql(c: Column) -> Column:
    """mask_entities() as the registered SQL has it."""
    for p, mask in ((SQL_URL, "<URL>"), (SQL_EMAIL, "<EMAIL>"), (SQL_HANDLE, "<USER>"), (SQL_PHONE, "$1<PHONE>$2")):
        c = F.regexp_replace(c, p, mask)
    return c


def map_emoticons(c: Column) -> Column:
    for face in sorted(EMOTICONS, key=len, reverse=True):
        c = F.replace(c, F.lit(face), F.lit(f"<EMOJI:{EMOTICONS[face]}>"))
    return c


def collapse_repeats(c: Column) -> Column:
    return F.regexp_replace(c, r"(.)\1{3,}", "$1$1$1")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_text(c: Column, collapse: bool = True) -> Column:
    c = strip_signatures(strip_html(repaired(c)))
    c = map_emoticons(emoji_named(mask_entities(normalize_unicode(c))))
    return collapse_whitespace(collapse_repeats(c) if collapse else c)


def normalize_for_hash(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), "<url>|<user>|<email>|<phone>|<emoji:[^>]*>", "")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def content_hash(c: Column) -> Column:
    return F.sha1(normalize_for_hash(c).cast("binary"))


def prompt_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


#: Fixed value: namespace of the ids of tickets, messages and articles.
NAMESPACE = "6f6a6d1e6b0a4b1a9c1a2f6b8d5c4a10"


def deterministic_id(*parts: Column | str) -> Column:
    """UUID version 5 of the parts joined by colons."""
    name = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), name.cast("binary")))
    variant = F.element_at(F.split(F.lit("8 9 a b 8 9 a b 8 9 a b 8 9 a b"), " "), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def caps_ratio(c: Column) -> Column:
    def share(plain: Column) -> Column:
        letters = F.length(F.regexp_replace(plain, r"[^\p{L}]+", ""))
        return F.when(letters == 0, 0.0).otherwise(F.length(F.regexp_replace(plain, r"[^\p{Lu}]+", "")) / letters)

    return F.element_at(F.transform(F.array(F.regexp_replace(c, "<(?:URL|USER|EMAIL|PHONE|EMOJI:[^>]*)>", " ")), share), 1)


def punctuation_intensity(c: Column) -> Column:
    return F.least(F.regexp_count(c, F.lit("[!?]")), F.lit(5)) / 5


def urgency_score(c: Column) -> Column:
    def one(low: Column, pattern: str) -> Column:
        words = URGENCY_WORDS.get(pattern, (pattern.replace(r"\b", ""),))
        some = functools.reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])
        return F.when(some, F.rlike(low, F.lit("(?U)" + pattern)).cast("int")).otherwise(0)

    def hits(low: Column) -> Column:
        """The weighed number of patterns that the text has."""
        return sum((one(low, p) for p in HIGH_URGENCY), F.lit(0)) * 2.0 + sum((one(low, p) for p in MEDIUM_URGENCY), F.lit(0)) * 1.0

    found = F.element_at(F.transform(F.array(F.lower(c)), hits), 1)  # lower-cased once a text
    return caps_ratio(c) * 3.0 + punctuation_intensity(c) + found


def urgency_label(score: Column) -> Column:
    return F.when(score >= HIGH_FROM, "high").when(score >= MEDIUM_FROM, "medium").otherwise("low")


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != "")


def parse_timestamp(c: Column) -> Column:
    """`Tue Oct 31 20:00:00 +0000 2017`; what does not fit is null."""
    return F.try_to_timestamp(F.regexp_replace(c, r"^\w+ ", ""), F.lit("MMM dd HH:mm:ss Z yyyy"))


def parse_ids(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def inbound(c: Column) -> Column:
    return F.lower(F.trim(c)) == "true"


def week_start(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def iso_week(ts: Column) -> Column:
    label = F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.coalesce(label, F.lit("unknown"))


def language_vote(c: Column) -> Column:
    """struct(lang, confidence): the language most of whose function words stand in the text, and its share of all such
    hits; ties go to the first code. Blank texts, and texts without a hit: null and 0."""
    tokens = F.split(F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}]+", " "))), " ")
    tokens = F.filter(tokens, lambda w: w.isin(*sorted({w for known in STOP_VOTE.values() for w in known.split()})))

    def hits(some: Column, known: str) -> Column:
        return F.size(F.filter(some, lambda w: w.isin(*known.split())))

    def count(some: Column) -> Column:
        return F.array(*[F.struct(hits(some, known).alias("n"), F.lit(lang).alias("lang")) for lang, known in sorted(STOP_VOTE.items())])

    votes = F.element_at(F.transform(F.array(tokens), lambda some: count(some)), 1)

    def verdict(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0), lambda a, x: a + x["n"])
        best = F.aggregate(v, F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("lang")), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
        return F.struct(best["lang"].alias("lang"), F.when(total > 0, best["n"] / total).otherwise(0.0).alias("confidence"))

    return F.element_at(F.transform(F.array(votes), lambda v: verdict(v)), 1)


def seeded(ident: Column, seed: int | str) -> Column:
    """A 60-bit number that orders ids at random for a seed, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def signed(label: Column, score: Column) -> Column:
    return F.when(label == "positive", score).when(label == "negative", -score).otherwise(0.0)
