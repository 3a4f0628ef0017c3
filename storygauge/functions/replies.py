"""Reading what a text generator sent back: JSON repair, extraction, labels and point claims.

A reply is read in two steps that are both data: ``PLACES`` where an object may stand in it, in the order of trust, and
``REPAIRS``, substitutions that turn the usual slips into JSON. A ``Reader`` is a choice of both; the columns are generated from
the same table of repairs.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from storygauge.functions.text import UNICODE, strip
from storygauge.schemas import HALLUCINATION_LABELS

# --- fixed values: the slips that are repaired, in order, where objects stand, and point claims ---------
TRAILING_COMMA = (r",\s*([}\]])", "$1")
REPAIRS = (
    TRAILING_COMMA,
    ("[“”]", '"'),
    ("[‘’]", "'"),
    (r"\bTrue\b", "true"),
    (r"\bFalse\b", "false"),
    (r"\bNone\b", "null"),
    (r"'([^'\\]*)'", '"$1"'),
)
FENCED_OBJECT = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
WIDEST_OBJECT = r"(?s)(\{.*\})"
JSON_TOKEN = r'(?s)\\.|["{}]|[^\\"{}]+'
WHOLE_TEXT = r"^\s*[+-]?\d+\s*$"
DECIMAL_TEXT = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
POINT_CLAIM = r"(?i)(?:story\s*points?|estimate(?:d)?(?:\s+at)?)\s*[:=]?\s*(\d+)"
# ------------------------------------------------------------------------------------------------

Repair = tuple[str, str]


# --- repairs, as columns and as text ---------------------------------------------------------------
def drop_trailing_commas(text: Column) -> Column:
    return _repaired_column(text, (TRAILING_COMMA,))


def repair_json(text: Column) -> Column:
    """Turn the usual slips of generated JSON into valid JSON, as far as text rules can."""
    return _repaired_column(strip(text), REPAIRS)


def _repaired_column(text: Column, repairs: Sequence[Repair]) -> Column:
    return reduce(lambda done, repair: F.regexp_replace(done, UNICODE + repair[0], repair[1]), repairs, text)


def _repaired_text(text: str, repairs: Sequence[Repair]) -> str:
    for slip, cure in repairs:
        text = re.sub(slip, cure.replace("$", "\\"), text)
    return text


# --- places of an object ---------------------------------------------------------------------------
def _first_closed(text: str) -> str:
    """From the first opening brace to the one that closes it, strings skipped; empty when none does."""
    start = text.find("{")
    depth, quoted = 0, False
    for token in re.finditer(JSON_TOKEN, text[start:]) if start >= 0 else ():
        sign = token[0] if quoted else token[0].removeprefix("\\")  # an escape means something inside a string only
        if sign == '"':
            quoted = not quoted
        elif not quoted and sign in ("{", "}"):
            depth += 1 if sign == "{" else -1
            if depth == 0:
                return text[start:start + token.end()]
    return ""


def _matched(pattern: str) -> Callable[[str], str]:
    """The first match of a pattern's group; empty without one."""
    return lambda text: next((m[1] for m in re.finditer(pattern, text)), "")


PLACES = {"fenced": _matched(FENCED_OBJECT), "closed": _first_closed, "widest": _matched(WIDEST_OBJECT), "whole": str}


@dataclass(frozen=True)
class Reader:
    """Finds the first JSON object of a reply: at each place in turn, after each set of repairs in turn."""

    places: tuple[str, ...]
    repairs: tuple[tuple[Repair, ...], ...]

    def attempts(self, reply: str) -> Iterator[str]:
        for place in self.places:
            found = PLACES[place](reply).strip()
            yield from (_repaired_text(found, repairs) for repairs in (self.repairs if found else ()))

    def read(self, reply: str | None) -> dict | None:
        return next((value for value in map(_decoded, self.attempts(reply or "")) if isinstance(value, dict)), None)


OBJECTS = Reader(("fenced", "closed", "widest", "whole"), ((), REPAIRS))
LABELS = Reader(("widest",), ((TRAILING_COMMA,),))


def _decoded(text: str) -> object:
    """What JSON text stands for; None where it is none, which is no object either."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _storable(value: object) -> object:
    """JSON has no NaN or infinity and UTF-8 no half surrogates; the former become text, the latter a mark."""
    if isinstance(value, dict):
        return {_storable(str(k)): _storable(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_storable(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(value, str) else value


# --- one reply: the same code decides about a retry and makes the result ----------------------------
def read_object(reply: str | None) -> str | None:
    """The first JSON object of a reply as JSON text; None without one."""
    value = OBJECTS.read(reply)
    return None if value is None else json.dumps(_storable(value), ensure_ascii=False)


def read_label(reply: str | None) -> str | None:
    """The label that a classifier's reply holds, in lower case; None when it holds no valid one."""
    said = str((LABELS.read(reply) or {}).get("label")).strip().lower()
    return {label: label for label in HALLUCINATION_LABELS}.get(said)


@F.pandas_udf(T.StringType())
def object_text(raw: pd.Series) -> pd.Series:
    return raw.map(read_object)


@F.pandas_udf(T.StringType())
def label_of(raw: pd.Series) -> pd.Series:
    """Label of a classifier reply in lower case; NULL when the reply has no valid one."""
    return raw.map(read_label)


# --- fields of an object, as columns over VARIANT ---------------------------------------------------
def json_object(raw: Column) -> Column:
    """The JSON object inside a reply, as VARIANT; NULL when there is none."""
    return F.try_parse_json(object_text(raw))


def text_field(payload: Column, name: str) -> Column:
    return strip(F.try_variant_get(payload, f"$.{name}", "string"))


def _member(payload: Column, name: str) -> Column:
    return F.try_variant_get(payload, f"$.{name}", "variant")


def _is_text(member: Column) -> Column:
    return F.schema_of_variant(member) == "STRING"


def number_field(payload: Column, name: str) -> Column:
    """A number, a truth value or a text that spells a number; NULL for all else."""
    text = F.try_variant_get(payload, f"$.{name}", "string")
    readable = ~_is_text(_member(payload, name)) | text.rlike(DECIMAL_TEXT)
    return F.when(readable, F.try_variant_get(payload, f"$.{name}", "double"))


def whole_field(payload: Column, name: str, default: int | None) -> Column:
    """Number cut to a whole one, or a text that spells a whole one; ``default`` where the field is absent.

    NULL where the field holds anything else or a number beyond 32 bits: such a reply is an error, see ``unreadable``.
    """
    member = _member(payload, name)
    text = F.try_variant_get(payload, f"$.{name}", "string")
    number = F.when(~_is_text(member) | text.rlike(WHOLE_TEXT), F.try_variant_get(payload, f"$.{name}", "double"))
    return F.when(member.isNull(), F.lit(default).cast("int")).otherwise(F.when(F.abs(number) < F.lit(2.0**31), number.cast("int")))


def unreadable(payload: Column, name: str, value: Column) -> Column:
    """Whether the field is there but ``value``, what was read from it, is not."""
    return payload.isNotNull() & _member(payload, name).isNotNull() & value.isNull()


def flag_field(payload: Column, name: str) -> Column:
    """Boolean field, NULL where it is absent and false where it is null.

    The words true and false are read as such, other texts, numbers and lists by being non-empty.
    """
    text = F.lower(F.try_variant_get(payload, f"$.{name}", "string"))
    empty = F.coalesce(text, F.lit("")).isin("false", "", "0", "0.0", "[]", "{}")
    return F.when(_member(payload, name).isNotNull(), ~empty)


def subtasks_of(payload: Column) -> Column:
    """Subtasks of a reply as an array of structs; entries that are not objects are skipped.

    ``story_points`` is NULL where an entry's points cannot be read.
    """
    entries = F.try_variant_get(payload, "$.subtasks", "array<variant>")
    objects = F.filter(entries, lambda e: F.schema_of_variant(e).startswith("OBJECT"))
    built = F.transform(
        objects,
        lambda e: F.struct(
            text_field(e, "title").alias("title"),
            whole_field(e, "story_points", 1).alias("story_points"),
            text_field(e, "reasoning").alias("reasoning"),
        ),
    )
    return F.coalesce(built, F.array().cast("array<struct<title string, story_points int, reasoning string>>"))


def claimed_points(text: Column) -> Column:
    """Digits that follow the first mention of points or of an estimate; NULL without such a claim."""
    digits = F.regexp_extract(F.coalesce(text, F.lit("")), UNICODE + POINT_CLAIM, 1)
    return F.nullif(digits, F.lit(""))


def agrees_with_points(text: Column, points: Column) -> Column:
    """False only when the text claims a number of points other than the given one."""
    digits = claimed_points(text)
    number = F.coalesce(digits.try_cast("bigint"), F.lit(-1))
    return F.when(digits.isNull() | points.isNull(), F.lit(True)).otherwise(number == points.cast("bigint"))
