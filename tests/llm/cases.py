"""Rows that the tests of this folder share."""

import datetime
import random

SMALL = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _key string, size int, copies string, _n date, "
    "score double, class_id string, _doc string, _u double, label map<string,int>"
)


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 8))) for _ in range(n))


def messy_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    long_text = words(1, 30_000)
    body = words(2, 120)
    near = body.replace(body.split()[60], "changed", 1)
    texts = [
        (1, body, "en", "a"), (2, body, "en", "a"), (3, body.replace(" ", " \t\n", 3), "en", "b"), (4, near, "en", "b"),
        (5, None, "de", "a"), (6, "", "de", "a"), (7, "   \n", None, "b"), (8, long_text, "en", "c"), (9, words(3, 3), "fr", None),
        (None, words(4, 50), "fr", None), (None, None, None, None), (10, words(5, 80), "en", "a"), (10, words(5, 80), "en", "a"),
        (10, words(6, 80), "en", "a"), (11, "1234 5678 !?", "en", "c"), (12, "ß É Ω 漢字 🙂 " + words(7, 40), "en", "c"), (13, "a", "en", "c"),
        (14, "9" * 5_000, "en", "c"), (15, "x@" * 2_000 + "end", "de", "c"),
    ]
    return [(i, t, lang, s, 0, "k", 1, "c", datetime.date(2020, 1, 1), 0.5, "z", "d", 0.1, {"a": 1}) for i, t, lang, s in texts]
