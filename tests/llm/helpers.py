"""Small documents that hold what operators must not trip over."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in ("ba", "ri", "to", "lu") for b in ("n", "s", "mar", "") for c in ("e", "ing", "o", "ed", "al")]


def prose(rnd: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        s = [rnd.choice(WORDS) for _ in range(rnd.randint(4, 12))]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n])


def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, an id with two texts."""
    rnd = random.Random(4)
    long = prose(rnd, 30_000)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (None, "some text of no one", "en", "a", 19), (4, long, "de", "b", len(long)), (5, "x" * 20_000, None, "b", 20_000),
        (6, prose(rnd, 80), "en", "a", 1), (6, prose(rnd, 80), "en", "a", 1), (7, "same words here and there again", "fr", "c", 1), (7, "same words here and there again", "fr", "c", 1),
        (8, "É\x1c\x85\u00a0ü 😀 中文 \ud7ff 123", "es", "d", 1), (9, "\n\n\n", "es", "d", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
