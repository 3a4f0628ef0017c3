"""Neighbour lists kept as JSON text or as arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from storygauge.functions.replies import number_field, whole_field
from storygauge.functions.rounding import fixed
from storygauge.functions.text import issue_keys_in, key_stem, one_line, strip
from storygauge.schemas import NEIGHBOUR_ITEM, SUBTASK_ITEM


def parse_items(raw: Column, item_ddl: str) -> Column:
    """JSON array to array of structs; a text that is not one complete array gives an empty list.

    Numbers may be written as texts, and whole numbers lose a fraction; what spells no number is NULL.
    """
    fields = [f.split() for f in item_ddl.split(", ")]
    whole = strip(raw)
    array = F.when(whole.startswith("["), whole)
    # the parser stops after the first value; no text that goes on can be the only member of an object and of a list
    member = F.try_parse_json(F.concat(F.lit('{"v":'), array, F.lit("}")))
    listed = F.try_parse_json(F.concat(F.lit("["), array, F.lit("]")))
    items = F.when(listed.isNotNull(), F.try_variant_get(member, "$.v", "array<variant>"))

    def value(item: Column, name: str, kind: str) -> Column:
        if kind == "string":
            return F.try_variant_get(item, f"$.{name}", "string")
        return number_field(item, name) if kind == "double" else whole_field(item, name, None)

    objects = F.filter(items, lambda t: F.schema_of_variant(t).startswith("OBJECT"))
    built = F.transform(objects, lambda t: F.struct(*[value(t, n, k).alias(n) for n, k in fields]))
    return F.coalesce(built, F.array().cast(f"array<struct<{item_ddl}>>"))


def parse_neighbours(raw: Column) -> Column:
    return parse_items(raw, NEIGHBOUR_ITEM)


def parse_subtasks(raw: Column) -> Column:
    return parse_items(raw, SUBTASK_ITEM)


def has_neighbours(items: Column) -> Column:
    return F.size(F.coalesce(items, F.array())) > 0


def neighbours_json(items: Column) -> Column:
    """JSON text of a neighbour list, as the results table stores it."""
    return F.to_json(
        F.transform(
            items,
            lambda t: F.struct(
                t["issue_key"].alias("issue_key"),
                t["story_points"].alias("story_points"),
                t["similarity"].alias("similarity"),
                t["title"].alias("title"),
            ),
        )
    )


def neighbour_line(items: Column) -> Column:
    """``KEY (0.83), KEY (0.79)``"""

    def entry(t: Column) -> Column:
        key, similarity = F.coalesce(t["issue_key"], F.lit("None")), F.coalesce(t["similarity"], F.lit(0.0))
        return F.format_string("%s (%s)", key, fixed(similarity, 2))

    return F.array_join(F.transform(items, entry), ", ")


def neighbour_examples(items: Column) -> Column:
    """Prompt block with one line per neighbour; items carry title and description."""

    def entry(t: Column) -> Column:
        title = F.coalesce(F.nullif(t["title"], F.lit("")), F.lit("Untitled"))
        return F.format_string(
            "- %s (%d SP, similarity %s): %s — %s",
            t["issue_key"], t["story_points"], fixed(t["similarity"], 2), title, one_line(t["description"]),
        )

    return F.array_join(F.transform(items, entry), "\n")


def retrieved_keys(items: Column, fallback_text: Column) -> Column:
    """Upper-case neighbour keys: from the list when it has any entry, else mentioned in the text."""
    named = F.filter(F.transform(items, lambda t: F.upper(t["issue_key"])), lambda k: k.isNotNull() & (k != ""))
    return F.when(F.size(items) > 0, F.array_distinct(named)).otherwise(issue_keys_in(fallback_text))


def same_stem_share(key: Column, items: Column) -> Column:
    """Share of the neighbours whose key has the same project part."""
    hits = F.size(F.filter(items, lambda t: key_stem(F.coalesce(t["issue_key"], F.lit(""))) == key_stem(key)))
    return F.when(F.size(items) > 0, hits / F.size(items))
