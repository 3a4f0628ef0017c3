"""Mixing sources to target weights by Pareto order sampling.

Sources share all words by weight, each at most ``most`` times its own words; the excess is shared again. Within a
source a document's expected copies grow with a power of its size (``lean``) up to ``most``, scaled so that the expected
words equal the target. Whole copies are certain. For the remaining fraction ``pi`` a document is ranked by random odds
over inclusion odds, ``u/(1-u) / (pi/(1-pi))``, and the lowest ranks enter until the source's remaining words are taken:
the sample's size is fixed in words, to within half of one document.

A null text has size 0 and is never taken; a null source is a source like any other, the last one. Rows that repeat id
and text share one random number and one decision. Nothing is chosen by order of arrival, so reruns agree. An empty
table gives an empty mix. Words of very long texts are counted whole. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from storygauge.llm.common import WORD, durable, small_side, staged

FINE = 1 << 20  # cells of the rank scale; one source's rows are summed by cell, and ranked one by one in a single cell
COARSE = 1 << 10
SEED = 20_011


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """``source, weight``: the sources by code point, null last, weigh the numbers of the cycle in turn."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in cycle]), place % len(cycle)))


def water_level(rows: DataFrame, by: list[str], total: Column, limit: Column, weight: Column, order: Column, name: str) -> DataFrame:
    """``by`` and the level at which ``min(level * weight, limit)`` adds up to the total; null where all are at their limit.

    ``order`` sorts the rows by limit over weight, the first to be full in front.
    """
    groups = [F.col(c) for c in by] or [F.lit(0)]
    whole = Window.partitionBy(*groups)
    before = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    free = F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    level = rows.select(*by, (F.greatest(total - used, F.lit(0.0)) / free).alias("_level"), limit.alias("_limit"),
                        weight.alias("_weight"), order.alias("_order"))
    fits = F.col("_weight") * F.col("_level") <= F.col("_limit") * (1 + 1e-12)
    return level.filter(F.col("_weight") > 0).groupBy(*by).agg(F.min_by("_level", F.when(fits, F.col("_order"))).alias(name))


def targets(sources: DataFrame, most: float) -> DataFrame:
    """``source, weight, source_size`` with ``target``."""
    wide = sources.withColumn("_total", F.sum("source_size").over(Window.partitionBy(F.lit(0))).cast("double"))
    full = F.col("source_size") * F.lit(float(most))
    level = water_level(wide, [], F.col("_total"), full, F.col("weight"), full / F.col("weight"), "_level")
    one = level.select("_level").withColumn("_one", F.lit(1))
    target = F.least(F.coalesce(F.col("_level") * F.col("weight"), full), full)
    return wide.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one", "left").withColumn("target", target).drop("_one", "_total", "_level")


class Mix:
    """The plan of one mix: a small table by source, and the columns that decide a row by it.

    Whatever is summed or ranked is one narrow staged row a document; the rows of a source that holds a third of them
    are summed cell by cell before they move, and only those of one cell in a million are ranked together.
    """

    def __init__(self, docs: DataFrame, weights: DataFrame | None = None, most: int = 3, lean: float = 0.25, seed: int = SEED):
        self.most, self.lean, self.seed = most, lean, seed
        self.narrow = durable(docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            size_of(F.col("text")).alias("size"), self.draw(F.col("doc_id").cast("long"), F.col("text")).alias("_u"),
        ))
        self.plan, self.count = staged(self._plan(weights))

    def draw(self, doc_id: Column, text: Column) -> Column:
        """A number between 0 and 1 from the first 13 hexadecimal digits of an MD5."""
        key = F.concat_ws(":", F.lit(str(self.seed)), F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit("")))
        return (F.conv(F.left(F.md5(key), F.lit(13)), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)

    def _plan(self, weights: DataFrame | None) -> DataFrame:
        sizes = durable(self.narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("_n")))
        sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
        if weights is None:
            weighed = cyclic_weights(sources)
        else:
            weighed = sources.join(weights.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        aimed = durable(targets(weighed, self.most))
        rows = sizes.filter("size > 0").withColumnRenamed("source", "_s").join(aimed, F.col("source").eqNullSafe(F.col("_s")))
        words = (F.col("size") * F.col("_n")).cast("double")
        gain = F.pow(F.col("size").cast("double"), F.lit(self.lean))
        level = water_level(rows, ["source"], F.col("target"), words * self.most, words * gain, -F.col("size"), "_level")
        level = level.withColumnRenamed("source", "_l")
        graded = rows.join(level, F.col("source").eqNullSafe(F.col("_l")), "left").withColumn("_whole", F.floor(self.expected()))
        rest = graded.groupBy(F.col("source").alias("_r")).agg(
            (F.first("target") - F.sum(F.col("_whole") * words)).alias("_rest"), F.first("_level").alias("_level"),
        )
        base = durable(aimed.join(rest, F.col("source").eqNullSafe(F.col("_r")), "left").drop("_r"))
        return self._cuts(base)

    def _cuts(self, base: DataFrame) -> DataFrame:
        """The base plan with ``_cell`` and ``_cut``: ranks below the cell enter, in the cell those up to the cut."""
        rows = self.attach(self.narrow.filter("size > 0"), base).withColumn("_v", self.rank()).filter(F.col("_v") < 1)
        rows = durable(rows.select("source", "size", "_v", "_rest"))
        fine = F.least(F.floor(F.col("_v") * FINE), F.lit(FINE - 1)).cast("int")
        rows = rows.withColumn("_coarse", F.floor(fine / (FINE // COARSE)).cast("int")).withColumn("_cell", fine)
        found = None
        for key in ("_coarse", "_cell"):
            inside = rows if found is None else self._within(rows, found, "_coarse")
            found = self._first_beyond(inside, key, found)
        last = self._within(rows, found, "_cell").groupBy("source", "_v").agg(F.sum("size").alias("_s"), F.first("_rest").alias("_rest"), F.first("_from").alias("_from"))
        running = F.sum("_s").over(Window.partitionBy("source").orderBy("_v")) - F.col("_s") + F.col("_from")
        enters = last.withColumn("_enters", running + F.col("_s") / 2 <= F.col("_rest"))
        cut = enters.groupBy("source").agg(F.max(F.when(F.col("_enters"), F.col("_v"))).alias("_cut"))
        cells = found.select(F.col("source").alias("_c"), "_cell")
        cut = cut.withColumnRenamed("source", "_d")
        return (
            base.join(cells, F.col("source").eqNullSafe(F.col("_c")), "left").drop("_c")
            .join(cut, F.col("source").eqNullSafe(F.col("_d")), "left").drop("_d")
        )

    @staticmethod
    def _within(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
        side = found.select(F.col("source").alias("_f"), F.col(key).alias("_k"), "_from")
        return rows.join(side, F.col("source").eqNullSafe(F.col("_f")) & (F.col(key) == F.col("_k"))).drop("_f", "_k")

    @staticmethod
    def _first_beyond(rows: DataFrame, key: str, found: DataFrame | None) -> DataFrame:
        """By source the first cell whose words go beyond the rest, and the words before it."""
        start = F.lit(0).cast("long") if found is None else F.col("_from")
        sums = rows.select("source", key, "size", "_rest", start.alias("_from")).groupBy("source", key).agg(
            F.sum("size").alias("_s"), F.first("_rest").alias("_rest"), F.first("_from").alias("_from"),
        )
        running = F.sum("_s").over(Window.partitionBy("source").orderBy(key)) + F.col("_from")
        over = sums.withColumn("_to", running).filter(F.col("_to") > F.col("_rest"))
        first = over.groupBy("source").agg(F.min(F.struct(key, (F.col("_to") - F.col("_s")).alias("_from"))).alias("_x"))
        return durable(first.select("source", f"_x.{key}", "_x._from"))

    def attach(self, rows: DataFrame, plan: DataFrame, count: int = 0) -> DataFrame:
        side = plan.withColumnRenamed("source", "_p")
        return rows.join(small_side(side, count or side.count()), F.col("source").eqNullSafe(F.col("_p"))).drop("_p")

    def expected(self) -> Column:
        grown = F.col("_level") * F.pow(F.col("size").cast("double"), F.lit(self.lean))
        return F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.coalesce(grown, F.lit(float(self.most))), F.lit(float(self.most))))

    def rank(self) -> Column:
        """Random odds over inclusion odds, on a scale from 0 to 1; 1 where nothing is left to chance."""
        pi = self.expected() - F.floor(self.expected())
        return F.when(pi <= 0, 1.0).otherwise(F.col("_u") * (1 - pi) / (F.col("_u") * (1 - pi) + (1 - F.col("_u")) * pi))

    def copies(self) -> Column:
        """How often the mix takes a row that has ``size``, ``_u`` and the plan's columns."""
        v = self.rank()
        cell = F.least(F.floor(v * FINE), F.lit(FINE - 1))
        below = F.col("_cell").isNull() | (cell < F.col("_cell")) | ((cell == F.col("_cell")) & (v <= F.col("_cut")))
        extra = F.when((v < 1) & F.coalesce(below, F.lit(False)), 1).otherwise(0)
        return F.when(F.col("size") == 0, 0).otherwise(F.floor(self.expected()) + extra).cast("long")


def mix(docs: DataFrame, weights: DataFrame | None = None, most: int = 3, lean: float = 0.25, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``."""
    plan = Mix(docs, weights, most, lean, seed)
    rows = plan.attach(plan.narrow, plan.plan, plan.count).withColumn("copies", plan.copies())
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, most: int = 3, lean: float = 0.25, seed: int = SEED) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns; texts are not shuffled."""
    plan = Mix(docs, weights, most, lean, seed)
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("source").cast("string").alias("source"),
        size_of(F.col("text")).alias("size"), plan.draw(F.col("doc_id").cast("long"), F.col("text")).alias("_u"),
    )
    chosen = plan.attach(held, plan.plan, plan.count).withColumn("_copies", plan.copies()).filter("_copies > 0")
    return chosen.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).select("_doc.*")
