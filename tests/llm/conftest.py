import random

import pytest

#: Texts that every operator must take: null, empty, blanks, one word, other scripts, repeated lines, long.
AWKWARD = [
    None, "", "   \n\t ", "word", "naïve Über straße ÷ × ½", "漢字 かな 한글 \U0001f600 ـ", "<|endoftext|>x<|endoftext|>", "can't won't 'tis it's", "same line\nsame line\nsame line",
    "x" * 5000, "lorem ipsum " * 4000, "a\x00b\x1fc", "▁under ▁score", "tab\tand\r\nreturn",
]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from texts, with repeated and null ids, and columns whose names the operators use themselves."""

    def of(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, ("en", "de", None)[k % 3], ("s0", "s1", None)[k % 3], len(t or ""), k, "x", 1.5) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, kept string, rate double")

    return of


@pytest.fixture(scope="session")
def awkward(make):
    n = len(AWKWARD)
    return make([*AWKWARD, *AWKWARD[:6]], [*range(n - 1), None, 0, 1, None, None, 4, 5])


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["an", "the", "er", "on", "sh", "ti", "re", "io", "ly"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
