"""One-permutation MinHash fingerprints of word shingles, densified and cut to packed low-order bits.

Every shingle of five words is hashed once. The hash's high bits choose one of 128 bins, the smallest hash of a bin
represents it. An empty bin borrows from the first non-empty bin in a random order of its own, an affine permutation of
all bins, so that the search always ends. Four low-order bits of each bin are kept, 16 bins to a 64-bit word. Two
fingerprints agree by chance in a sixteenth of the bins, which ``likeness`` corrects for.

Words are separated by white space. A text of fewer than five words is one shingle; a text without words (or null) has
the fingerprint of an empty shingle. Equal texts have equal fingerprints. Long texts are hashed whole. Repeated rows and null ids
are rows like others, null ids last in the order of ids; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, functions as F

from storygauge.llm.common import SPACES, durable, let, texts
from storygauge.operators.ingest import number_rows

SHINGLE = 5
BIN_BITS, LOW_BITS = 7, 4
BINS, LANES = 1 << BIN_BITS, 64 // LOW_BITS
TRIES = 3  # bins of the random order that are looked up one by one, before all non-empty bins are compared


def probe_orders(seed: int = 7) -> tuple[list[int], list[int], list[int]]:
    """For each bin the start and the odd step of its order, and the step's inverse modulo the number of bins."""
    draw = random.Random(seed)
    starts = [draw.randrange(BINS) for _ in range(BINS)]
    steps = [2 * draw.randrange(BINS // 2) + 1 for _ in range(BINS)]
    return starts, steps, [pow(s, -1, BINS) for s in steps]


def words_of(text: Column) -> Column:
    blanks = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(blanks, " "), lambda w: w != "")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """A hash for each run of ``size`` words; one for all words where there are fewer."""
    def shingles(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - size)
        return F.when(F.size(h) < size, F.array(F.xxhash64(h))).otherwise(
            F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + d) for d in range(size)])))

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), shingles)


def _bin_of(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - BIN_BITS).cast("int")


def _smallest_of_bins(hashes: Column) -> Column:
    """For each non-empty bin its number and the low bits of its smallest hash, as ``bin * 16 + bits``."""
    def firsts(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (_bin_of(x) != _bin_of(F.get(h, F.greatest(i - 1, F.lit(0))))))

    low = F.lit((1 << LOW_BITS) - 1).cast("long")
    return F.transform(let(F.sort_array(hashes), firsts), lambda x: F.shiftleft(_bin_of(x), LOW_BITS) + x.bitwiseAND(low).cast("int"))


def _densified(entries: Column) -> Column:
    """The low bits of all bins, the empty ones filled."""
    starts, steps, inverses = (F.array(*[F.lit(x) for x in xs]) for xs in probe_orders())
    mask, low = F.lit(BINS - 1), F.lit((1 << LOW_BITS) - 1)

    def fill(e: Column) -> Column:
        def nearest(j: Column) -> Column:
            place = lambda x: ((F.shiftright(x, LOW_BITS) - F.get(starts, j)) * F.get(inverses, j)).bitwiseAND(mask)
            return F.array_min(F.transform(e, lambda x: F.shiftleft(place(x), LOW_BITS) + x.bitwiseAND(low))).bitwiseAND(low)

        def bins(m: Column) -> Column:
            probe = lambda j, t: F.get(m, (F.get(starts, j) + F.get(steps, j) * t).bitwiseAND(mask))
            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.coalesce(F.get(m, j), *[probe(j, t) for t in range(TRIES)], nearest(j)))

        return let(_spread(e), bins)

    return let(entries, fill)


def _spread(e: Column) -> Column:
    """An array of all bins, null where a bin is empty."""
    by_bin = F.map_from_arrays(F.transform(e, lambda x: F.shiftright(x, LOW_BITS)), F.transform(e, lambda x: x.bitwiseAND(F.lit((1 << LOW_BITS) - 1))))
    return let(by_bin, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.try_element_at(m, j)))


def fingerprint(text: Column) -> Column:
    """Eight 64-bit words that hold four bits of each of 128 bins."""
    def pack(v: Column) -> Column:
        group = lambda g: F.slice(v, g * LANES + 1, LANES)
        fold = lambda g: F.aggregate(group(g), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, LOW_BITS).bitwiseOR(x.cast("long")))
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // LANES - 1)), fold)

    return let(_densified(_smallest_of_bins(shingle_hashes(text))), pack)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles: equal bins, less what agrees by chance, between 0 and 1."""
    ones = F.lit(int("1" * (64 // LOW_BITS), 16)).cast("long")

    def differing(x: Column) -> Column:
        folded = x
        for shift in range(1, LOW_BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(folded.bitwiseAND(ones))

    unequal = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d)
    chance = 1.0 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), ((BINS - unequal) / float(BINS) - chance) / (1 - chance))


def as_hex(packed: Column) -> Column:
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


KEY = ("_unnamed", "_number", "_md5")


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select(
        F.col("doc_id").isNull().alias("_unnamed"), F.coalesce("doc_id", F.lit(0)).alias("_number"), F.unhex(F.md5("text")).alias("_md5"),
        "text",
    )


def with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text after half of it is replaced by the next document's beginning.

    The next document is the one with the next larger id, the first after the last; null ids come last, and of one id
    the texts are ordered by MD5. Rows that repeat id and text are one document here and have one result each.
    Columns: ``doc_id, n_chars, fingerprint, edited_text, edited_fingerprint, near_edited, near_next``. The texts are
    shuffled once by id, the beginnings of the next documents once more; the order is taken from narrow rows.
    """
    source = _keyed(docs)
    rows = durable(source.select(*KEY, F.length("text").cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fingerprint")))
    total = rows.count()
    numbered = number_rows(rows.dropDuplicates(list(KEY)), [F.col(k) for k in KEY], "_n")
    kinds = numbered.count()
    after = numbered.select(
        F.when(F.col("_n") == 1, F.lit(kinds)).otherwise(F.col("_n") - 1).alias("_n"),
        *[F.col(k).alias(f"_next{k}") for k in KEY], F.col("fingerprint").alias("_next_print"),
    )
    links = numbered.join(after, "_n").select(
        *KEY, "n_chars", "fingerprint", F.expr("n_chars div 2").alias("_half"), *[f"_next{k}" for k in KEY],
        likeness(F.col("fingerprint"), F.col("_next_print")).alias("near_next"),
    )
    nexts = source if kinds == total else source.dropDuplicates(list(KEY))
    begun = nexts.join(links.select(*[F.col(f"_next{k}").alias(k) for k in KEY], *[F.col(k).alias(f"_of{k}") for k in KEY], "_half", "n_chars", "fingerprint", "near_next"), list(KEY))
    begun = begun.select(
        *[F.col(f"_of{k}").alias(k) for k in KEY], "_half", "n_chars", "fingerprint", "near_next",
        F.substring("text", F.lit(1), F.col("_half").cast("int")).alias("_beginning"),
    )
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.col("_half")).cast("int"))
    edited = source.join(begun, list(KEY)).select(
        F.when(~F.col("_unnamed"), F.col("_number")).alias("doc_id"), "n_chars", "fingerprint", "near_next", F.concat(kept, F.col("_beginning")).alias("edited_text"),
    )
    printed = edited.withColumn("edited_fingerprint", fingerprint(F.col("edited_text")))
    return printed.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
