"""Documents with every odd case: NULLs, blanks, repeats, ties, one long text, and columns named as the operators name theirs."""

import random

import pytest

CLASH = "fp key root vertex host path p n s row hits label words block bucket start batch _key _hits _text _id rid word component_id kept"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH.split())


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 7))) for _ in range(n))


def odd_rows():
    rnd = random.Random(5)
    texts = [None, "", " \t\n", "one", "one two", "One\tTwo\nthree", "é ß 日本語 😀 ▁x", "a\x00b\x1cc d"]
    base = sentence(rnd, 90)
    texts += [base, base, base.replace("a", "A", 3), base + " tail", sentence(rnd, 60) + "\n" + sentence(rnd, 60)]
    texts += ["Spam!!! " * 80, "x | y\n" * 70, " ".join(["same"] * 400), sentence(rnd, 40_000), "no" * 30_000]
    texts += [sentence(rnd, rnd.randint(1, 120)) for _ in range(40)]
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base, "en", "a", 1), (None, None, None, None, None), (None, "lonely text here", None, "b", 3)]
    rows += [(9_007_199_254_740_993, "a large id", "en", "a", 10)]
    return [(*r, *CLASH.split()) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
