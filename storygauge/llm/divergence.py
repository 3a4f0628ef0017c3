"""How the sources of a language differ in the words they use: an exact audit by dominance skybands.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z in lower case. Each language keeps the terms found in at
least ``least_docs`` of its documents. Every (lang, source) group, and each language as a whole, gives each kept term a
smoothed share in whole billionths. Two parts come out of the same counts:

* ``pair``: for each source all other sources of its language by the summed differences of their shares;
* ``term``: for each source its ``top`` terms whose share exceeds the language's by most.

For the second part no share is needed at first. A term that another one beats or equals in group count (higher), in
language count (lower) and in UTF-8 order (earlier) ranks behind it whatever the totals turn out to be, so a term that
``top`` others dominate so can never be listed. Every task keeps only the skyband, the terms dominated by fewer than
``top`` others; skybands are merged, first by group and a salt, then by group; what is left is ranked exactly.

Texts are counted in the task that reads them, so one row per task, group and term is shuffled; that also merges the rows of
a source that holds a third of the corpus. Memory is bounded by ``MOST_TERMS`` counters a task and one text.

Null text, lang and source are empty strings; an empty text has no terms, but its group occurs and is compared. Repeated rows
count as often as they occur. Ties rank by UTF-8 order of the item. A language without kept terms gives value 0 to all pairs
and lists no terms; an empty table gives an empty result. Other columns are not read. Very long texts are counted whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from storygauge.llm.common import durable, small_side, staged

LEAST_DOCS = 30
TOP = 50
MOST_TERMS = 200_000  # counters that a task holds before it passes them on
SALTS = 16  # tasks that share the first merge of one group's skybands
TERMS_AT_ONCE = 2_048  # expected rows of one block of shares
SOURCES_AT_ONCE = 128  # columns of one block of shares
_SLAB = 1 << 22

# every byte that is no part of a term becomes a blank, A-Z becomes a-z
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _buffer(column: pa.Array) -> Iterator[bytes]:
    """The bytes of each text."""
    return (memoryview(s.as_buffer()).tobytes() if s.is_valid else b"" for s in column)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, source, term, n, docs``; the empty term stands for the group itself."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)
    held = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in counts.items():
            names, found = list(terms), docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()),
                 pa.array(names, pa.binary()).cast(pa.string()), pa.array([terms[t] for t in names], pa.int64()),
                 pa.array([found[t] for t in names], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        counts.clear()
        docs.clear()

    for batch in batches:
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for group, text in zip(groups, _buffer(batch.column("text"))):
            words = Counter(text.translate(_PLAIN).split(b" "))  # the empty word is there unless the whole text is one term
            words[b""] = 0
            own = counts[group]
            held -= len(own)
            own.update(words)
            held += len(own)
            docs[group].update(words.keys())
            if held > MOST_TERMS:
                yield from passed_on()
                held = 0
    yield from passed_on()


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Rows ``lang, source, term, n, lang_n, first`` of the kept terms, and one of the empty term per group.

    ``first`` marks one row of each term of a language. Partitioned by lang and term, so counting takes one shuffle.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(named("text"), named("lang"), named("source")).mapInArrow(
        _count_terms, "lang string, source string, term string, n long, docs long")
    groups = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    marked = groups.select(
        "lang", "source", "term", "n", F.sum("n").over(same).alias("lang_n"), F.sum("docs").over(same).alias("_docs"),
        (F.row_number().over(same.orderBy("source")) == 1).alias("first"),
    )
    return marked.filter((F.col("term") == "") | (F.col("_docs") >= least_docs)).drop("_docs")


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term in whole billionths, exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    parts, whole = wide(count + 5) * F.lit(1_000_000_000).cast("decimal(10,0)"), wide(total + terms * 5)
    return F.lit(1) + F.call_function("div", parts, whole)


# --- skybands --------------------------------------------------------------------------------------
def skyband(points: np.ndarray, top: int) -> np.ndarray:
    """Which rows (group count, language count), given in the order of their terms, fewer than ``top`` others dominate.

    A row is dominated by an earlier one of no lower group count and no higher language count. What is dominated too often
    need not be compared with: those that dominate it dominate all that it does.
    """
    kept = np.empty((0, 2), np.int64)
    chosen = np.zeros(len(points), bool)
    step = 256
    for lo in range(0, len(points), step):
        block = points[lo:lo + step]
        beaten = np.zeros(len(block), np.int64)
        for at in range(0, len(kept), _SLAB // step):
            part = kept[at:at + _SLAB // step]
            beaten += ((part[:, 0][None, :] >= block[:, 0][:, None]) & (part[:, 1][None, :] <= block[:, 1][:, None])).sum(1)
        within = (block[:, 0][None, :] >= block[:, 0][:, None]) & (block[:, 1][None, :] <= block[:, 1][:, None])
        inside = beaten + np.tril(within, -1).sum(1) < top  # earlier rows of the block count whether they stay or not
        chosen[lo:lo + step] = inside
        kept = np.concatenate([kept, block[inside]])
    return np.flatnonzero(chosen)


def _skybands(top: int):
    """Reads rows ``lang, source, term, n, lang_n`` in any order and returns each group's skyband among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list[pd.DataFrame]] = defaultdict(list)
        sizes: Counter = Counter()
        kept: Counter = Counter()

        def reduced(group: tuple) -> pd.DataFrame:
            rows = pd.concat(waiting[group], ignore_index=True)
            order = np.argsort(rows["term"].str.encode("utf-8").to_numpy(object), kind="stable")
            rows = rows.iloc[order]
            return rows.iloc[skyband(rows[["n", "lang_n"]].to_numpy(np.int64), top)]

        for batch in batches:
            for group, rows in batch.to_pandas().groupby(["lang", "source"], sort=False):
                waiting[group].append(rows)
                sizes[group] += len(rows)
                if sizes[group] > 4_096 + 2 * kept[group]:
                    waiting[group] = [reduced(group)]
                    sizes[group] = kept[group] = len(waiting[group][0])
        for group in waiting:
            yield pa.RecordBatch.from_pandas(reduced(group)[["lang", "source", "term", "n", "lang_n"]], preserve_index=False)

    return run


def skyband_terms(counts: DataFrame, top: int = TOP) -> DataFrame:
    """The rows ``lang, source, term, n, lang_n`` of all groups that can be among the first ``top`` of their group."""
    fields = "lang string, source string, term string, n long, lang_n long"
    found = counts.filter((F.col("term") != "") & (F.col("n") > 0)).select("lang", "source", "term", "n", "lang_n")
    found = found.mapInArrow(_skybands(top), fields)
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS))
    found = found.repartition("lang", "source", salt).mapInArrow(_skybands(top), fields)
    return found.repartition("lang", "source").mapInArrow(_skybands(top), fields)


# --- differences of whole sources ------------------------------------------------------------------
def _differences(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Summed absolute differences of all columns of one block of shares and all of another."""
    return np.stack([np.abs(right - left[:, i:i + 1]).sum(0) for i in range(left.shape[1])])


def source_differences(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows ``lang, left, right, excess``: of each two sources what seen terms add to the difference of unseen ones.

    Sources are cut in blocks of columns and terms in blocks of rows; a task holds the shares of two such blocks and leaves one
    row per pair behind. ``groups`` has ``lang, source, place, blocks, total, terms, unseen``.
    """
    rows = counts.filter("term <> '' AND n > 0").join(groups, ["lang", "source"])
    own = F.floor(F.col("place") / SOURCES_AT_ONCE).cast("int")
    cut = rows.select(
        "lang", "place", "unseen", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("share"), own.alias("own"),
        F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / TERMS_AT_ONCE)).cast("int").alias("bucket"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    # sources of a block that hold none of the bucket's terms still differ from those that do
    every = groups.filter("terms > 0").select("lang", "place", "unseen", own.alias("own"), "blocks", "terms")
    every = every.select(
        "lang", "place", "unseen", F.lit(None).cast("string").alias("term"), F.col("unseen").alias("share"), "own",
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("terms") / TERMS_AT_ONCE).cast("int") - 1)).alias("bucket"), "blocks",
    ).select("lang", "place", "unseen", "term", "share", "own", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    every = every.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    blocks = cut.unionByName(every).groupBy("lang", "a", "b", "bucket")
    parts = blocks.applyInPandas(_pairs_of, "lang string, left int, right int, excess long")
    return parts.groupBy("lang", "left", "right").agg(F.sum("excess").alias("excess"))


def _pairs_of(rows: pd.DataFrame) -> pd.DataFrame:
    """Both orders of each two different sources of a block pair."""
    seen = rows["term"].notna().to_numpy()
    a, b = int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
    term = np.full(len(rows), -1)
    term[seen], names = pd.factorize(rows["term"].to_numpy()[seen])
    place, unseen, value = rows["place"].to_numpy(), rows["unseen"].to_numpy(), rows["share"].to_numpy()

    def table(side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = place // SOURCES_AT_ONCE == side
        places, first, column = np.unique(place[mine], return_index=True, return_inverse=True)
        usual = unseen[mine][first]
        shares = np.repeat(usual[None, :], len(names), 0)
        there = term[mine] >= 0
        shares[term[mine][there], column[there]] = value[mine][there]
        return places, usual, shares

    left, right = table(a), table(b)
    excess = _differences(left[2], right[2]) - np.abs(left[1][:, None] - right[1][None, :]) * len(names)
    made = pd.DataFrame({"left": np.repeat(left[0], len(right[0])), "right": np.tile(right[0], len(left[0])), "excess": excess.ravel()})
    if a != b:
        made = pd.concat([made, made.rename(columns={"left": "right", "right": "left"})])
    made = made[made["left"] != made["right"]]
    return made.assign(lang=rows["lang"].iloc[0])[["lang", "left", "right", "excess"]]


# --- the audit -------------------------------------------------------------------------------------
def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank``: see the head of this file."""
    counts = durable(term_counts(docs, least_docs))
    by_lang = counts.groupBy("lang").agg(
        F.count_if(F.col("first") & (F.col("term") != "")).alias("terms"), F.sum("n").alias("lang_total"),
        F.countDistinct("source").alias("sources"),
    )
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(by_lang, "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # one row per source
    known, number = staged(totals.select(
        "lang", "source", "total", "terms", "lang_total", place.cast("int").alias("place"),
        F.ceil(F.col("sources") / SOURCES_AT_ONCE).cast("int").alias("blocks"),
        F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1)))).alias("unseen"),
    ))
    groups = small_side(known, number)

    excess = source_differences(counts, groups)
    side = lambda name: known.select(
        "lang", F.col("place").alias(name), F.col("source").alias(f"{name}_source"), F.col("unseen").alias(f"{name}_unseen"), "terms")
    pairs = side("left").join(side("right").drop("terms"), "lang").filter("left <> right").join(excess, ["lang", "left", "right"], "left")
    usual = F.abs(F.col("left_unseen") - F.col("right_unseen")) * F.col("terms")
    pairs = pairs.select(
        "lang", F.col("left_source").alias("source"), F.lit("pair").alias("part"), F.col("right_source").alias("item"),
        F.coalesce(usual + F.coalesce("excess", F.lit(0)), F.lit(0)).cast("long").alias("value"),
    )

    likely = skyband_terms(counts, top).join(groups, ["lang", "source"])
    above = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = likely.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above.cast("long").alias("value")).filter("value > 0")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))
