import random

import pytest

WORDS = [a + b for a in "ba de fi go ku la me no pi ru sa te vo wi za".split() for b in "n r s l t".split()]


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars, row, k1): copies, near copies, shared passages, long, blank and null ones; extra columns with names that operators use inside."""
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    texts = [prose(rng.randint(3, 160)) for _ in range(60)]
    base = prose(150)
    for _ in range(40):
        w = base.split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    passage = prose(70)
    texts += [f"{prose(40)} {passage} {prose(30)}" for _ in range(6)]
    texts += [texts[0]] * 4 + ["", "   \n\t ", None, "a" * 2500, "é" * 700, "Ba DE Fi", "ba de fi", prose(6000)]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", "s1", None)[i % 4], len(t or ""), "x", -i) for i, t in enumerate(texts)]
    rows += [(None, texts[1], "en", "s2", 1, "x", 0), (None, None, None, None, None, None, None), rows[5], rows[5]]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k1 long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
