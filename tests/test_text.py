import random

from pyspark.sql import functions as F

from storygauge.functions import text as ft
from storygauge.functions.text import WHITESPACE


def test_whitespace_is_what_unicode_calls_whitespace():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_removes_every_kind_of_whitespace(one):
    assert one([" a\n", "\ta ", "　", None, "a b"], ft.strip) == ["a", "a", "", "", "a b"]


def test_word_count_matches_whitespace_split(one):
    texts = ["", "  ", "a", " a b\nc\t\x1cd ", "a b", "\x85x"]
    assert one(texts, ft.word_count) == [len(t.split()) for t in texts]


def test_unquote_peels_pairs_only(one):
    cases = {
        '"a"': "a", ' "" "a" "" ': "a", '"': '"', '""': "", '"""': '"', '""""': "", '"a': '"a', 'a"': 'a"', '""a"': '"a',
        '" "b" "': "b", None: "", '"a" "b"': 'a" "b',
    }
    assert one(list(cases), ft.unquote) == list(cases.values())


def test_unquote_on_random_texts(one):
    rng = random.Random(1)
    texts = ["".join(rng.choice('""  \n\u3000ab') for _ in range(rng.randint(0, 14))) for _ in range(2000)]

    def peeled(text):
        inner = text.strip()
        while len(inner) > 1 and inner.startswith('"') and inner.endswith('"'):
            inner = inner[1:len(inner) - 1].strip()
        return inner

    assert one(texts, ft.unquote) == [peeled(t) for t in texts]


def test_description_of_bare_quotes_is_chosen_and_then_empty(spark):
    df = spark.createDataFrame([('""', "markup"), (" ", "markup"), (None, '"m"'), ("text", None)], "a string, b string")
    got = [r[0] for r in df.select(ft.pick_description(F.col("a"), F.col("b"))).collect()]
    assert got == ["", "markup", "m", "text"]


def test_one_line_keeps_the_limit_including_dots(one):
    got = one(["a\nb ", "x" * 300, "x" * 301], ft.one_line)
    assert got == ["a b", "x" * 300, "x" * 297 + "..."]


def test_snippet_keeps_the_limit_before_the_dots(one):
    assert one(["x" * 500, "x" * 501, None], ft.leading_snippet) == ["x" * 500, "x" * 500 + "...", ""]


def test_issue_keys(one):
    got = one(["see AB-1, AB-1 and XY2-33; not ab-2, A-1 or AB-x", "éAB-1 «CD-2»", None], ft.issue_keys_in)
    assert got == [["AB-1", "XY2-33"], ["CD-2"], []]


def test_embedding_text_with_and_without_title(spark):
    df = spark.createDataFrame([(" T ", " d\n"), (" ", "d"), (None, None)], "t string, d string")
    c = F.col
    got = df.select(ft.embedding_text(c("t"), c("d"), True), ft.embedding_text(c("t"), c("d"))).collect()
    assert [tuple(r) for r in got] == [("T\n\nd", "d"), ("d", "d"), ("", "")]


def test_key_and_name_defaults(spark):
    df = spark.createDataFrame([(None, 7, None), (" ", 8, " "), ("K-1", 9, "P")], "k string, i long, n string")
    got = df.select(ft.key_or_default(F.col("k"), F.col("i"), "GEN-"), ft.name_or_default(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("GEN-7", "Unknown"), ("GEN-8", "Unknown"), ("K-1", "P")]
