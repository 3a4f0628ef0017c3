"""Text clean-up and key expressions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: the code points that count as whitespace, and the tracker key pattern ----------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0         "
    "       　"
)
WHITESPACE_CLASS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"  # the same code points as a pattern
ISSUE_KEY_PATTERN = r"\b([A-Z][A-Z0-9]+-\d+)\b"
# ------------------------------------------------------------------------------------------------
UNICODE = "(?U)"  # letters, digits, spaces and word edges of patterns are those of Unicode


def strip(col: Column) -> Column:
    """Both ends freed of any whitespace; NULL becomes the empty string."""
    return F.btrim(F.coalesce(col, F.lit("")), F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def word_count(col: Column) -> Column:
    """Number of whitespace-separated words."""
    text = strip(col)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, f"{WHITESPACE_CLASS}+")))


def unquote(col: Column) -> Column:
    """Remove surrounding double-quote pairs, however many, and the whitespace between them."""
    text = strip(col)
    layers = F.length(F.regexp_extract(text, f'^(?:"|{WHITESPACE_CLASS})*', 0))

    def peel(value: Column, _: Column) -> Column:
        wrapped = (F.length(value) >= 2) & value.startswith('"') & value.endswith('"')
        return F.when(wrapped, strip(F.substring(value, F.lit(2), F.length(value) - 2))).otherwise(value)

    # most texts do not start with a quote and are only stripped
    quoted = F.coalesce(F.rlike(col, F.lit(rf'\A{WHITESPACE_CLASS}*"')), F.lit(False))
    return F.when(quoted, F.aggregate(F.sequence(F.lit(1), layers), text, peel)).otherwise(text)


def pick_description(plain: Column, markup: Column) -> Column:
    """The plain text when it is not blank, else the markup text; a text of bare quotes counts as chosen."""
    return F.when(~is_blank(plain), unquote(plain)).otherwise(unquote(markup))


def key_or_default(key: Column, row_id: Column, prefix: str) -> Column:
    return F.when(~is_blank(key), key).otherwise(F.concat(F.lit(prefix), row_id.cast("string")))


def name_or_default(name: Column, default: str = "Unknown") -> Column:
    return F.when(~is_blank(name), name).otherwise(F.lit(default))


def one_line(col: Column, limit: int = 300) -> Column:
    """Single-line text of at most ``limit`` characters, ending in dots when shortened."""
    text = strip(F.replace(F.coalesce(col, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    )


def leading_snippet(col: Column, limit: int = 500) -> Column:
    """The first ``limit`` characters, with dots added when there are more."""
    text = F.coalesce(col, F.lit(""))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def issue_keys_in(col: Column) -> Column:
    """Distinct tracker keys mentioned in a text, in upper case."""
    found = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(UNICODE + ISSUE_KEY_PATTERN), 1)
    return F.array_distinct(F.transform(found, F.upper))


def key_stem(key: Column) -> Column:
    """Project part of a key: what stands before the first dash."""
    return F.substring_index(key, "-", 1)


def embedding_text(title: Column, description: Column, include_title: bool = False) -> Column:
    """Text handed to the encoder: the description, optionally under its title."""
    body = strip(description)
    if not include_title:
        return body
    head = strip(title)
    return F.when(head != "", F.concat(head, F.lit("\n\n"), body)).otherwise(body)
