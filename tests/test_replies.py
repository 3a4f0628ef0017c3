import json
import random

from pyspark.sql import functions as F

from storygauge.functions import replies as fr

OBJECTS = {
    '{"a": 1}': {"a": 1},
    'Sure:\n```json\n{"a": {"b": 1}}\n```\nbye': {"a": {"b": 1}},
    "```\n{'a': 1,}\n```": {"a": 1},
    'text {"a": 1} more': {"a": 1},
    '{"a": [1, 2,],}': {"a": [1, 2]},
    "{'a': True, 'b': None}": {"a": True, "b": None},
    "{“a”: 1}": {"a": 1},
    '{"a": "} not the end {"}': {"a": "} not the end {"},
    '{"a": "quote \\" and }"}': {"a": 'quote " and }'},
    '{"a": 1} and {"b": 2}': {"a": 1},
    '{"a": "it}s",} don\'t {}': {"a": "it}s"},
    '[{"a": 1}]': {"a": 1},
}
NOTHING = ["", "no json", "[1, 2]", '{"a": ', "{", "}{"]


def test_json_object(one):
    got = one(list(OBJECTS), lambda c: fr.json_object(c).cast("string"))
    assert [json.loads(g) if g else g for g in got] == list(OBJECTS.values())
    assert one(NOTHING + [None], lambda c: fr.json_object(c).cast("string")) == [None] * (len(NOTHING) + 1)


def test_first_closed_object_on_random_texts():
    """Against a plain walk over the characters."""
    rng = random.Random(2)
    texts = ["".join(rng.choice('{}{}"\\ab\n') for _ in range(rng.randint(0, 16))) for _ in range(3000)]

    def closed(text):
        begin, depth, inside, skip = text.find("{"), 0, False, False
        for at in range(max(begin, 0), len(text) if begin >= 0 else 0):
            c = text[at]
            if skip:
                skip = False
            elif inside:
                skip, inside = c == "\\", c != '"'
            elif c == '"':
                inside = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    return text[begin:at + 1]
        return ""

    assert [fr._first_closed(t) for t in texts] == [closed(t) for t in texts]


PIECES = ["{", "}", '{"a": 1}', '{"a": 1, "a": 2}', '{"n": NaN}', '{"n": -Infinity}', "{x}", "'k'", ":", "[", "]", ",", "```", "json", "\n", '"', "\\",
          "True", "1e400", "\ud800", "é🙂", '{"big": 123456789012345678901234567890123456789012345}', '{"d": {"e": [1, {}]}}']


def test_what_is_accepted_can_be_read(one):
    """A reply needs no retry exactly when the column finds an object in it."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 7))) for _ in range(1500)]
    texts = [t.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for t in texts]
    texts += [*OBJECTS, *NOTHING, 'Draft {x} final {"story_points":5}', '{"a":"\\ud800"}']
    accepted = [fr.read_object(t) is not None for t in texts]
    found = one(texts, lambda c: fr.json_object(c).isNotNull())
    assert found == accepted and 200 < sum(accepted) < len(texts)


def test_the_last_of_equal_keys_counts(one):
    got = one(['{"story_points":3,"confidence":0.4,"story_points":5}', '{"story_points":3,"confidence":NaN}'],
              lambda c: fr.number_field(fr.json_object(c), "story_points"))
    assert got == [5.0, 3.0]
    assert fr.read_object('Draft {x} final {"story_points":5}') is None


def test_whole_numbers_are_read_or_refused(one):
    values = ["5", "5.9", '"5"', '" 7 "', '"5.0"', '"five"', "null", "3000000000", "-3e9", "true", "[1]", '"1e2"']
    replies = [f'{{"p": {v}}}' for v in values] + ["{}"]
    assert one(replies, lambda c: fr.whole_field(fr.json_object(c), "p", 3)) == [5, 5, 5, 7, None, None, None, None, None, 1, None, None, 3]
    read = lambda c: fr.unreadable(fr.json_object(c), "p", fr.whole_field(fr.json_object(c), "p", 3))
    assert one(replies, read) == [False] * 4 + [True] * 5 + [False, True, True, False]


def test_subtasks_skip_what_is_no_object(spark):
    raw = '{"subtasks": [{"title": " t ", "story_points": "3", "reasoning": "r"}, 5, null, {"title": "u"}]}'
    df = spark.createDataFrame([(raw,), ('{"subtasks": null}',), ('{"subtasks": "x"}',), ("{}",)], "v string")
    got = [r[0] for r in df.select(fr.subtasks_of(fr.json_object(F.col("v")))).collect()]
    assert [[tuple(s) for s in g] for g in got] == [[("t", 3, "r"), ("u", 1, "")], [], [], []]


def test_flag_reads_words(one):
    replies = ['{"c": "false"}', '{"c": "True"}', '{"c": true}', '{"c": 0}', "{}", '{"c": null}', '{"c": []}', '{"c": [0]}']
    got = one(replies, lambda c: fr.flag_field(fr.json_object(c), "c"))
    assert got == [False, True, True, False, None, False, False, True]


def test_labels(one):
    replies = ['{"label": "Grounded"}', 'I think {"label": " inferred ",}', '{"label": "maybe"}', "grounded", None,
               '{note} {"label":"grounded"}', '{"label":"grounded"} {"label":"inferred"}', '[{"label":"grounded"}]']
    assert one(replies, fr.label_of) == ["grounded", "inferred", None, None, None, None, None, "grounded"]
    assert [fr.read_label(r) for r in replies] == one(replies, fr.label_of)


def test_point_claims(spark):
    rows = [
        ("Story points: 8", 8, True), ("story point = 8", 5, False), ("estimated at 5 points", 5, True),
        ("I estimate 3, then story points 8", 8, False), ("no claim", 8, True), ("Story points: 8", None, True), (None, 3, True),
        ("estimate 99999999999999999999", 3, False),
    ]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(rows)], "i int, t string, p int").orderBy("i")
    assert [r[0] for r in df.select(fr.agrees_with_points(F.col("t"), F.col("p"))).collect()] == [r[2] for r in rows]


def test_columns_and_text_share_one_table_of_repairs(one):
    from storygauge.functions import replies as fr

    texts = ["{'a': 1,}", "{“a”: ‘b’, \"c\": True,\n}", "[1, 2 ,\u00a0]", "Nonesuch None_ None", "{'it': 'a\\'b'}", "'' 'x' True,]", "", "plain"]
    assert one(texts, fr.repair_json) == [fr._repaired_text(t.strip(), fr.REPAIRS) for t in texts]
    assert one(texts, fr.drop_trailing_commas) == [fr._repaired_text(t, (fr.TRAILING_COMMA,)) for t in texts]


def test_a_reader_is_its_places_and_repairs():
    from storygauge.functions import replies as fr

    reply = "first {'a': 1} then ```json\n{\"b\": 2}\n``` and {\"c\": 3,}"
    assert fr.OBJECTS.read(reply) == {"b": 2} and fr.LABELS.read(reply) is None
    assert fr.Reader(("closed",), (fr.REPAIRS,)).read(reply) == {"a": 1}
    assert fr.Reader(("closed",), ((),)).read(reply) is None and fr.OBJECTS.read(None) is None


def test_lists_that_go_on_are_no_lists(one):
    from storygauge.functions.neighbours import parse_neighbours

    good = '[{"issue_key": "K", "story_points": 3, "similarity": 0.5}]'
    tails = ["}", "]", ', "x": 2', '}, {"v": [2]', ', "v": [2]', "}]", "},1]", '}, 1', '},""]', " and more", "[]"]
    sizes = one([good, f" {good}\n", "[]", None, "", "{}", "7", *[good + t for t in tails]], lambda c: F.size(parse_neighbours(c)))
    assert sizes == [1, 1] + [0] * (5 + len(tails))
