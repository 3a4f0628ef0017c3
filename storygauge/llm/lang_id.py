"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lowered, everything between letters becomes one blank, and its runs of one to three characters are hashed into
``FEATURES`` features. Document frequencies count every labelled row. The regression is trained by follow-the-
regularised-leader with elastic-net penalties on at most ``PER_CLASS`` rows of each language, fewer where there are more
than 40, and never less than ``LEAST_ROWS`` of those there are. Every language is learned. The rows are chosen by a hash of the id
and brought to the driver as feature counts; each also lends a short snippet, for the sake of short texts. A part of the
sample is held out to calibrate the temperature of the scores.

A null text, and one without a letter, is ``und`` with score 0, as is every text where no row is labelled. Long texts are
read whole. Repeated rows and null ids are rows like others; an empty table gives an empty result. Other columns are not read by
``identify`` and carried along by ``accepted``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from storygauge.llm.common import per_process, small_batches, unit_interval

FEATURES = 1 << 14
ORDERS = 3
PER_CLASS = 1_000  # labelled rows of a language that are learned from, at most
SAMPLE_ROWS, LEAST_ROWS = 40_000, 20  # of all languages together, about; of each, however many there are
UNDETERMINED = "und"
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter; built once a process."""
    return per_process("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def characters(text: str | None) -> np.ndarray:
    """Code points of the lowered text, one blank for each stretch without letters; empty if there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = letter_table()[points]
    if not letter.any():
        return np.empty(0, np.uint32)
    points = np.concatenate(([32], np.where(letter, points, 32), [32])).astype(np.uint32)
    return points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]


def ngram_counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs."""
    counts, rolling = np.zeros(FEATURES, np.int64), points
    for order in range(ORDERS):
        if order:
            rolling = rolling[:-1] * np.uint32(_MULTIPLIERS[order]) + points[order:]
        mixed = rolling * np.uint32(_MULTIPLIERS[0]) + np.uint32(order)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(_MULTIPLIERS[1])
        counts += np.bincount(mixed >> np.uint32(32 - 14), minlength=FEATURES)
    present = np.flatnonzero(counts)
    return present, counts[present]


@dataclass
class Model:
    """Languages, inverse document frequencies, weights (features by languages), biases and the temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, present: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = (1 + np.log(counts)) * self.idf[present]
        return values / np.sqrt((values * values).sum())

    def logits(self, present: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(present, counts) @ self.weights[present] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        points = characters(text)
        if not len(points) or not self.languages:
            return UNDETERMINED, 0.0
        chances = softmax(self.logits(*ngram_counts(points)) / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(languages: list[str], idf: np.ndarray, samples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4,
          alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 5) -> Model:
    """FTRL-proximal with per-coordinate rates; L1 keeps the weights sparse, L2 small."""
    classes = len(languages)
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))  # the last row is the bias
    model = Model(languages, idf, z, z[-1])

    def weights(rows: np.ndarray, sparse: np.ndarray) -> np.ndarray:
        zs = z[rows]
        shrunk = np.where(np.abs(zs) > l1 * sparse, zs - np.sign(zs) * l1 * sparse, 0.0)
        return -shrunk / ((beta + np.sqrt(n[rows])) / alpha + l2)

    vectors = [(np.append(p, FEATURES), np.append(model.vector(p, c), 1.0)[:, None], y) for p, c, y in samples]
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(vectors)):
            rows, x, y = vectors[i]
            penal = np.where(rows < FEATURES, 1.0, 0.0)[:, None]
            w = weights(rows, penal)
            error = softmax((x * w).sum(axis=0))
            error[y] -= 1
            g = x * error
            before = n[rows]
            after = before + g * g
            z[rows] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
            n[rows] = after
    everything = np.arange(FEATURES + 1)
    final = weights(everything, np.where(everything < FEATURES, 1.0, 0.0)[:, None])
    return Model(languages, idf, final[:-1].astype(np.float32), final[-1])


def calibrate(model: Model, held: list[tuple[np.ndarray, np.ndarray, int]]) -> float:
    """The temperature that makes held-out labels likeliest, from a fixed grid."""
    if not held:
        return 1.0
    logits, labels = np.array([model.logits(p, c) for p, c, _ in held]), np.array([y for *_, y in held])
    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 81))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def snippet(points: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    size = int(draw.integers(8, 60))
    start = int(draw.integers(0, max(1, len(points) - size)))
    return points[start:start + size]


def fit(docs: DataFrame, learns: Column, per_class: int = PER_CLASS) -> Model:
    """A model of the rows with a label for which ``learns`` holds; ids choose the sample, and only texts are features."""
    small_batches(docs.sparkSession)
    rows = docs.filter(learns & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), "text", unit_interval(F.xxhash64(F.lit(77), "doc_id", "text")).alias("_u"))
    counted = rows.groupBy("lang").count().collect()
    languages, sizes = sorted(r[0] for r in counted), {r[0]: r[1] for r in counted}
    place = {lang: i for i, lang in enumerate(languages)}
    most = min(per_class, max(LEAST_ROWS, SAMPLE_ROWS // max(1, len(languages))))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                points = characters(text.as_py())
                if len(points):
                    total[ngram_counts(points)[0]] += 1
                    total[FEATURES] += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["feature", "n"])

    summed = rows.select("text").mapInArrow(frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect()
    df = np.zeros(FEATURES + 1)
    for feature, count in summed:  # at most one row a feature
        df[feature] = count
    idf = (1 + np.log((1 + df[FEATURES]) / (1 + df[:FEATURES]))).astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for lang, text, u in zip(*(c.to_pylist() for c in batch.columns)):
                points = characters(text)
                if len(points) and lang in place:
                    draw = np.random.default_rng(int(u * (1 << 52)))
                    for kind, part in enumerate((points, snippet(points, draw))):
                        present, counts = ngram_counts(part)
                        made.append((place[lang], u, kind, present.astype("<u2").tobytes(), counts.astype("<u4").tobytes()))
            types = [pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
            columns = list(zip(*made)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["y", "u", "kind", "present", "counts"])

    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, 0.9 * most / size)) for lang, size in sizes.items()], "lang string, _share double")
    chosen = rows.join(F.broadcast(shares), "lang").filter(F.col("_u") < F.col("_share")).select("lang", "text", "_u")
    sample = chosen.mapInArrow(features, "y int, u double, kind int, present binary, counts binary")
    taken, samples, held, per = sample.collect(), [], [], {}
    for row in sorted(taken, key=lambda r: (r.u, r.kind, r.y, bytes(r.present))):
        per[row.y] = per.get(row.y, 0) + 1
        if per[row.y] <= 2 * most:
            item = (np.frombuffer(row.present, "<u2").astype(np.int64), np.frombuffer(row.counts, "<u4").astype(np.int64), row.y)
            (held if int(row.u * (1 << 40)) % 5 == 0 else samples).append(item)
    learned = {y for *_, y in samples}
    samples += [item for item in held if item[-1] not in learned]  # a language of a few rows may have fallen into the held-out part whole
    held = [item for item in held if item[-1] in learned]
    model = train(languages, idf, samples) if samples else Model([], idf, np.zeros((FEATURES, 0)), np.zeros(0))
    model.temperature = calibrate(model, held)
    return model


def predicted(text: Column, model: Model) -> Column:
    """``lang_pred`` and ``score`` of a text; only the text travels to Python, and only they come back."""
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

    return run(text)


def lettered(text: Column) -> Column:
    @F.arrow_udf(T.BooleanType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([len(characters(t.as_py())) > 0 for t in texts], pa.bool_())

    return run(text)


def held_out() -> Column:
    """Rows that no model learns from: those whose checksum of the id is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``; rows that are not held out are learned from."""
    model = fit(docs, ~held_out(), per_class)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), predicted(F.col("text"), model).alias("_p"))
    return found.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def accepted(docs: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents whose language is told, whatever the score, with all their columns; where nothing can be learned, those with a letter."""
    model = fit(docs, ~held_out(), per_class)
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    told = predicted(F.col("text"), model)["lang_pred"] != UNDETERMINED if model.languages else lettered(F.col("text"))
    return docs.select(held, told.alias("_told")).filter("_told").select("_doc.*")
