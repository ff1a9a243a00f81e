import random
import re

from threadloom.operators import spans

PIECES = [*spans.PRODUCTS[::9], *spans.RELATIVE[::5], "order ", "RMA no. ", "account ", "12345", "1Z" + "A1" * 8, "ending in 1234", "$25.50", "USD 40", "15 dollars", "charged me ", "12/04/2023", "Mar. 2024", "3rd of may", "two weeks ago", "ſubscriber 12345", "Kindle", " ", "x", "_"]


def test_rules_find_what_whole_scans_find():
    rng, compiled = random.Random(5), [(name, label, re.compile(p)) for name, label, p in spans.RULES]
    for _ in range(500):
        text = "".join(rng.choice(PIECES) + rng.choice(["", " "]) for _ in range(rng.choice([1, 3, 12])))
        for name, _label, p in compiled:
            low = None if spans.FOLDED.search(text) else text.lower()
            assert [m.span("v") for m in spans.matches(name, p, text, low)] == [m.span("v") for m in p.finditer(text)]


def test_rules_scan_long_texts_where_a_match_can_begin_only():
    tried = []

    class Counted:
        def match(self, text, at):
            tried.append(at)

    list(spans.matches("product_gazetteer", Counted(), "prose " * 1000 + "a Kindle", "prose " * 1000 + "a kindle"))
    assert tried == [6002]
