"""Licence scans by canonical digests: entire texts are looked up among the digests of known licences.

The canonical form of a text has no lines that begin with a copyright mark, only lower-case words of letters and digits,
and one of several equivalent spellings. Two texts of equal canonical form have equal digests (MD5, 128 bits). The digest
of every entire text is joined with the table of known digests; so is that of every entire line, for the notices that a
document holds. The known table is a parameter; the default has a few dozen rows.

That form depends on where lines break, since a sentence that wraps before "copyright" loses a line. A text is therefore
also looked up by all its words, in which only copyright notices ahead of a known text's opening words are left out: from
a mark with a year, a sign or a name to the end of its paragraph or to the opening. Long licences (Apache, GPL, LGPL, GFDL, MPL,
Artistic, CC0) are known by the digest of all words of their published texts, however these are wrapped. ``digest`` stays that
of the canonical form.

A null text counts as empty. An empty canonical form is no licence. Long texts are read whole. Repeated rows and null ids
are rows like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from storygauge.llm.common import let, texts
from storygauge.llm.license_texts import LICENSES, NOTICES, SPELLINGS, WORDING_MARKS, WORDINGS

COPYRIGHT_LINE = r"(?im)^[^\p{L}\p{N}\n]*(?:\(c\)|copyright|©)[^\n]*$"
NOT_A_WORD = r"[^\p{L}\p{N}]+"
#: A notice up to the end of its paragraph: a sign, or the word with a year, a sign or a name.
COPYRIGHT_NOTICE = (
    r"(?s)(?<![\p{L}\p{N}])(?:\([cC]\)|©|(?i:copyright)[\s:,]*(?:\([cC]\)|©|[0-9\[<{]|\p{Lu}|by\s|the\s)).*?(?=\n[^\S\n]*\n|$)"
)
OPENING = 5  # first words of a known text by which its beginning is found


def words(text: Column) -> Column:
    """Words with two blanks between them and one at either end, so that each can be replaced on its own."""
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), NOT_A_WORD, "  ")), F.lit(" "))
    for spelling, usual in SPELLINGS:
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {usual} "))
    return out


def canonical(text: Column) -> Column:
    return words(F.regexp_replace(text, COPYRIGHT_LINE, ""))


def digest(text: Column) -> Column:
    return F.md5(canonical(text))


def known_licenses(spark: SparkSession) -> DataFrame:
    """``license, text`` of the licences known by default, with and without their titles, and of common notices."""
    rows = [(name, text) for name, _, text in LICENSES] + [(name, f"{title}\n\n{text}") for name, title, text in LICENSES]
    return spark.createDataFrame(rows + NOTICES, "license string, text string")


def digests(known: DataFrame) -> DataFrame:
    """``digest, license``, one row a digest; of several licences the first by name."""
    return known.select(digest(F.col("text")).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def openings(known: DataFrame) -> tuple[str, list[str]] | None:
    """A pattern of the place before the first words of any known text, and words of which a text with such a place holds one."""
    first = F.slice(F.split(F.trim(words(F.col("text"))), " +"), 1, OPENING)
    found = sorted({tuple(r[0]) for r in known.select(first).distinct().collect()} - {("",)})
    spelt = [NOT_A_WORD.join(w.replace("license", "licen[cs]e") for w in ws) for ws in found]
    usual = {x for _, u in SPELLINGS for x in u.split()}
    marks = {max((w for w in ws if w not in usual), key=len, default="") for ws in found}
    pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}])(?=(?:{'|'.join(spelt)})(?![\p{{L}}\p{{N}}]))"
    return (pattern, sorted(marks)) if spelt else None


def wording(text: Column, opening: str, marks: list[str]) -> Column:
    """Digest of a text's words without the notices ahead of the first opening; null without an opening."""
    def run(parts: Column) -> Column:
        ahead = F.regexp_replace(parts[0], COPYRIGHT_NOTICE, "")
        return F.when(F.size(parts) > 1, F.md5(words(F.concat_ws("\n", ahead, F.get(parts, F.lit(1))))))

    found = let(F.split(F.concat(F.lit("\n"), text), opening, 2), run)
    return F.when(let(F.lower(text), lambda low: reduce(or_, (F.contains(low, F.lit(m)) for m in marks))), found)


def known_wording(text: Column, wordings: list[tuple[str, str]]) -> Column:
    """The long licence whose words, all of them, are the text's; null for other texts."""
    names = F.create_map(*[F.lit(x) for name, digest_ in wordings for x in (digest_, name)])
    marked = let(F.lower(text), lambda low: reduce(or_, (F.contains(low, F.lit(m)) for m in WORDING_MARKS)))
    return F.when(marked, F.try_element_at(names, F.md5(words(text))))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per document: ``doc_id, digest, license`` of the entire text, and ``notices``, the licences of entire lines.

    The known digests must be few enough to be sent to every task; no text is shuffled.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    table = digests(known)
    listed = table.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("_known"))
    worded = known.groupBy(F.md5(words(F.col("text"))).alias("digest")).agg(F.min("license").alias("license"))
    worded = worded.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias("_worded"))
    opening = openings(known)
    empty = F.md5(F.lit("  "))
    source = texts(docs).withColumn("digest", digest(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(x) > 0)
    source = source.withColumn("_lines", F.when(F.contains("text", F.lit("\n")), F.transform(lines, digest)).otherwise(F.array("digest")))
    source = source.withColumn("_long", known_wording(F.col("text"), WORDINGS))
    source = source.withColumn("_wording", wording(F.col("text"), *opening) if opening else F.lit(None).cast("string"))
    joined = source.drop("text").join(F.broadcast(table), "digest", "left").withColumn("_known", listed.scalar())
    license_ = F.when(F.col("digest") != empty, F.col("license"))
    joined = joined.withColumn("license", F.coalesce(license_, F.try_element_at(worded.scalar(), F.col("_wording")), "_long"))
    found = let(F.transform("_lines", lambda d: F.try_element_at("_known", d)), lambda x: F.array_sort(F.array_distinct(F.array_compact(x))))
    return joined.select(
        "doc_id", "digest", "license", F.array_join(found, ",").alias("notices"))
