"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A token's input joins a word embedding, by a hash of the word, with a character embedding, the mean over the hashes of its
runs of three to five characters; so words never seen in training still have an input. Two gated recurrent layers read a
window of ``WINDOW`` tokens from either end, attention pools their states, and a linear layer gives the window's logit.
Every overlapping window of a text is scored, and a logistic regression over the largest, the mean and the mean of the
three largest logits and the number of windows gives the text's score.

The network learns from windows of at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled documents, chosen by a hash of the id
(no more than ``WINDOWS_EACH`` windows of one text); the regression from three others for every seven, with all their windows. Only
texts are inputs. Words are lower case; a null or empty text has no window and the share of toxic labels as its score,
as has every text where only one label is known. Repeated rows and null ids are rows like others; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from storygauge.llm import shingles
from storygauge.llm.common import small_batches, unit_interval

WINDOW, STRIDE = 64, 32
BUCKETS, EMBED, HIDDEN, ATTEND = 1 << 16, 8, 8, 8
GRAMS = (3, 4, 5)
MOST_TOXIC, MOST_CLEAN, WINDOWS_EACH = 1_200, 2_400, 5
BETWEEN = np.ones(256, bool)  # bytes between words: all but lower-case letters, digits and bytes beyond ASCII
BETWEEN[97:123] = BETWEEN[48:58] = BETWEEN[128:] = False
BATCH = 2_048
TRAINED_WINDOWS = 60_000
FOR_NETWORK = 0.7  # share of the sample that the network learns from; the regression learns from the rest


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Vocabulary:
    """The distinct words of a chunk: the bucket of each, and the buckets of its character runs."""

    def __init__(self, words: shingles.Words):
        _, first, self.token = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.word = (words.hashes[first] >> np.uint64(48)).astype(np.int64)
        starts, sizes = words.starts[first], words.ends[first] - words.starts[first]
        # the words side by side, each between two marks
        begin = np.concatenate(([0], np.cumsum(sizes + 2)))
        place = np.arange(begin[-1]) - np.repeat(begin[:-1], sizes + 2)
        inner = (place > 0) & (place <= np.repeat(sizes, sizes + 2))
        text = np.ones(begin[-1], np.uint64)
        text[inner] = words.data[(np.repeat(starts, sizes + 2) + place - 1)[inner]].astype(np.uint64) + np.uint64(2)
        up, down = shingles.powers(len(text))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(text * up[:len(text)], dtype=np.uint64)))
        grams, owner = [], []
        left = np.repeat(begin[1:], sizes + 2) - np.arange(begin[-1])  # characters up to the word's end
        who = np.repeat(np.arange(len(sizes)), sizes + 2)
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            grams.append((shingles.mixed((sums[at + n] - sums[at]) * down[at] + np.uint64(n)) >> np.uint64(48)).astype(np.int64))
            owner.append(who[at])
        self.grams, self.owner = grams, owner
        self.count = np.maximum(1, sum(np.bincount(o, minlength=len(sizes)) for o in owner)).astype(np.float32)

    def characters(self, table: np.ndarray) -> np.ndarray:
        """The mean embedding of each word's character runs."""
        total = np.zeros((len(self.word), table.shape[1]), np.float64)
        for gram, owner in zip(self.grams, self.owner):
            sums = np.concatenate((np.zeros((1, table.shape[1])), np.cumsum(table[gram], axis=0, dtype=np.float64)))
            ends = np.searchsorted(owner, np.arange(len(self.word) + 1))
            total += sums[ends[1:]] - sums[ends[:-1]]
        return (total / self.count[:, None]).astype(np.float32)


class Network:
    """Parameters, the forward pass, and the gradients by hand. Arrays are steps by windows by units."""

    def __init__(self, seed: int = 3):
        draw = np.random.default_rng(seed)
        normal = lambda *shape: (draw.normal(0, 1 / np.sqrt(shape[0]), shape)).astype(np.float32)
        self.words, self.grams = np.zeros((BUCKETS, EMBED), np.float32), np.zeros((BUCKETS, EMBED), np.float32)
        self.p = {
            "input": normal(2 * EMBED, 6 * HIDDEN), "bias": np.zeros(6 * HIDDEN, np.float32),
            "forth": normal(HIDDEN, 3 * HIDDEN), "back": normal(HIDDEN, 3 * HIDDEN),
            "attend": normal(2 * HIDDEN, ATTEND), "focus": normal(ATTEND), "out": normal(2 * HIDDEN), "shift": np.zeros(1, np.float32),
        }

    def inputs(self, vocabulary: Vocabulary) -> np.ndarray:
        return np.concatenate((self.words[vocabulary.word], vocabulary.characters(self.grams)), axis=1)

    def layer(self, given: np.ndarray, mask: np.ndarray, recur: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction; ``given`` holds the projected inputs."""
        steps, many, _ = given.shape
        states, trace = np.empty((steps, many, HIDDEN), np.float32), []
        h = np.zeros((many, HIDDEN), np.float32)
        for t in reversed(range(steps)) if back else range(steps):
            moved = h @ recur
            gates = sigmoid(given[t, :, :2 * HIDDEN] + moved[:, :2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(given[t, :, 2 * HIDDEN:] + r * moved[:, 2 * HIDDEN:])
            m = mask[t][:, None]
            new = h + m * (1 - z) * (n - h)
            if keep:
                trace.append((t, h, z, r, n, moved[:, 2 * HIDDEN:]))
            states[t] = h = new
        return states, trace

    def forward(self, projected: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        half = 3 * HIDDEN
        forth, trace_f = self.layer(projected[:, :, :half], mask, self.p["forth"], False, keep)
        back, trace_b = self.layer(projected[:, :, half:], mask, self.p["back"], True, keep)
        states = np.concatenate((forth, back), axis=2)
        u = np.tanh(states @ self.p["attend"])
        energy = np.where(mask > 0, u @ self.p["focus"], -1e9)
        share = np.exp(energy - energy.max(axis=0))
        share /= share.sum(axis=0)
        pooled = (share[:, :, None] * states).sum(axis=0)
        return pooled @ self.p["out"] + self.p["shift"][0], (trace_f, trace_b, states, u, share, pooled, mask)

    def backward(self, trace: tuple, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of the projected inputs."""
        trace_f, trace_b, states, u, share, pooled, mask = trace
        p, g = self.p, {}
        g["out"], g["shift"] = pooled.T @ d_logit, np.array([d_logit.sum()])
        d_pooled = d_logit[:, None] * p["out"]
        d_share = (states * d_pooled).sum(axis=2)
        d_states = share[:, :, None] * d_pooled
        d_energy = share * (d_share - (share * d_share).sum(axis=0))
        g["focus"] = (u * d_energy[:, :, None]).sum(axis=(0, 1))
        d_u = d_energy[:, :, None] * p["focus"] * (1 - u * u)
        g["attend"] = np.einsum("tbi,tbj->ij", states, d_u)
        d_states = d_states + d_u @ p["attend"].T
        d_projected = np.zeros((*states.shape[:2], 6 * HIDDEN), np.float32)
        for name, steps, first in (("forth", trace_f, 0), ("back", trace_b, HIDDEN)):
            recur, total = p[name], np.zeros_like(p[name])
            d_h = np.zeros((states.shape[1], HIDDEN), np.float32)
            for t, h, z, r, n, moved in reversed(steps):
                d_h = d_h + d_states[t, :, first:first + HIDDEN]
                m = mask[t][:, None]
                d_new = m * d_h
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (h - n) * z * (1 - z)
                d_r = d_n * moved * r * (1 - r)
                d_moved = np.concatenate((d_z, d_r, d_n * r), axis=1)
                d_projected[t, :, 3 * first:3 * first + 3 * HIDDEN] = np.concatenate((d_z, d_r, d_n), axis=1)
                total += h.T @ d_moved
                d_h = d_h - d_new * (1 - z) + d_moved @ recur.T
            g[name] = total
        return g, d_projected

    def logits(self, projected: np.ndarray, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Logits of windows given as token places (first, then on) into the projected distinct words."""
        out = np.empty(len(sizes), np.float32)
        order = np.argsort(sizes, kind="stable")
        for a in range(0, len(order), BATCH):
            chosen = order[a:a + BATCH]
            steps = np.arange(int(sizes[chosen].max()))[:, None]
            mask = (steps < sizes[chosen]).astype(np.float32)
            out[chosen], _ = self.forward(projected[windows[chosen, :len(steps)].T], mask)
        return out


def window_starts(tokens: int) -> np.ndarray:
    """Starts of all windows of a text; the last one ends with the text."""
    if tokens <= WINDOW:
        return np.zeros(min(tokens, 1), np.int64)
    starts = np.arange(0, tokens - WINDOW, STRIDE)
    return np.append(starts, tokens - WINDOW)


def text_logits(column: pa.Array, network: Network) -> Iterator[np.ndarray]:
    """For each text the logits of all its windows."""
    for words in shingles.chunks(pc.utf8_lower(column), BETWEEN):
        if not len(words.hashes):
            yield from (np.empty(0, np.float32) for _ in words.places[1:])
            continue
        vocabulary = Vocabulary(words)
        projected = network.inputs(vocabulary) @ network.p["input"] + network.p["bias"]
        starts = [a + window_starts(b - a) for a, b in zip(words.places[:-1], words.places[1:])]
        ends = np.repeat(words.places[1:], [len(s) for s in starts])
        flat = np.concatenate(starts)
        sizes = np.minimum(WINDOW, ends - flat)
        found = np.empty(len(flat), np.float32)
        for a in range(0, len(flat), 8 * BATCH):
            part = flat[a:a + 8 * BATCH]
            places = np.minimum(part[:, None] + np.arange(WINDOW), len(vocabulary.token) - 1)
            found[a:a + 8 * BATCH] = network.logits(projected, vocabulary.token[places], sizes[a:a + 8 * BATCH])
        yield from np.split(found, np.cumsum([len(s) for s in starts])[:-1])


def summary(logits: np.ndarray) -> list[float]:
    """What the regression sees of a text's windows; none for a text without words."""
    top = np.sort(logits)[-3:]
    return [float(top[-1]), float(logits.mean()), float(top.mean()), float(np.log(len(logits)))]


# --- training --------------------------------------------------------------------------------------
def train(windows: list[str], labels: np.ndarray, groups: np.ndarray, steps: int = TRAINED_WINDOWS, batch: int = 128, rate: float = 0.01,
          drop: float = 0.3, seed: int = 4) -> Network:
    """Windows carry their document's label. In the second half of the rounds, of a toxic document only the likelier half of its windows.

    There are as many rounds as bring about ``steps`` windows past the network, 4 to 60.
    """
    network, draw = Network(), np.random.default_rng(seed)
    epochs = min(60, max(4, round(steps / max(1, len(windows)))))
    words = list(shingles.chunks(pa.array(windows), BETWEEN, size=1 << 30))[0]
    vocabulary = Vocabulary(words)
    sizes = np.minimum(np.diff(words.places), WINDOW)
    usable = np.flatnonzero(sizes > 0)
    # a word or a run of a single document can only tell that document, so it has no embedding of its own
    documents = np.int64(groups.max(initial=0) + 1)
    of_token = groups[np.repeat(np.arange(len(windows)), np.diff(words.places))]
    pairs = np.unique(vocabulary.token * documents + of_token)
    of_word = np.bincount(pairs // documents, minlength=len(vocabulary.word))
    shared = (of_word > 1).astype(np.float32)
    places = np.minimum(words.places[:-1, None] + np.arange(WINDOW), len(vocabulary.token) - 1)
    gram, owner = np.concatenate(vocabulary.grams), np.concatenate(vocabulary.owner)
    order = np.argsort(owner, kind="stable")
    gram, bounds = gram[order], np.searchsorted(owner[order], np.arange(len(vocabulary.word) + 1))
    starts = np.searchsorted(pairs // documents, np.arange(len(vocabulary.word)))
    lone = np.flatnonzero(of_word == 1)  # most words; of the others every run is in several documents anyway
    told = np.full(BUCKETS, -1, np.int64)  # the only document known to hold a run, -2 for several
    for word, document in zip(lone, pairs[starts[lone]] % documents):
        own = gram[bounds[word]:bounds[word + 1]]
        told[own] = np.where((told[own] == -1) | (told[own] == document), document, -2)
    for word in np.flatnonzero(of_word > 1):
        told[gram[bounds[word]:bounds[word + 1]]] = -2
    known = (told[gram] == -2).astype(np.float32)[:, None]
    slow = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    seen = [np.full((BUCKETS, 1), 1e-4, np.float32) for _ in range(2)]
    step = 0
    for epoch in range(epochs):
        active = usable
        if epoch >= epochs // 2:
            projected = network.inputs(vocabulary) @ network.p["input"] + network.p["bias"]
            logit = np.full(len(sizes), -np.inf, np.float32)
            logit[usable] = network.logits(projected, vocabulary.token[places[usable]], sizes[usable])
            active = np.array([i for i in usable if not labels[i] or logit[i] >= np.median(logit[usable[groups[usable] == groups[i]]])])
        active = active[draw.permutation(len(active))]
        for a in range(0, len(active), batch):
            chosen = active[a:a + batch]
            steps = int(sizes[chosen].max())
            mask = (np.arange(steps)[:, None] < sizes[chosen]).astype(np.float32)
            token = vocabulary.token[places[chosen, :steps].T]
            own, local = np.unique(token, return_inverse=True)
            local = local.reshape(token.shape)
            spans = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in own])
            lengths = (bounds[own + 1] - bounds[own])
            of = np.repeat(np.arange(len(own)), lengths)
            heard = ((draw.random(len(own)) >= drop) * shared[own]).astype(np.float32)[:, None]
            characters = np.add.reduceat(network.grams[gram[spans]] * known[spans], np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0) / lengths[:, None]
            x = np.concatenate((network.words[vocabulary.word[own]] * heard, characters), axis=1).astype(np.float32)
            projected = x @ network.p["input"] + network.p["bias"]
            logit, trace = network.forward(projected[local], mask, keep=True)
            error = (sigmoid(logit) - labels[chosen]) / len(chosen)
            grads, d_projected = network.backward(trace, error.astype(np.float32))
            flat, at = d_projected.reshape(-1, d_projected.shape[2]), local.ravel()
            rank = np.argsort(at, kind="stable")
            d_own = np.add.reduceat(flat[rank], np.searchsorted(at[rank], np.arange(len(own))), axis=0)
            grads["input"], grads["bias"] = x.T @ d_own, d_own.sum(axis=0)
            d_x = d_own @ network.p["input"].T
            step += 1
            for name, g in grads.items():
                mean, square = slow[name]
                mean += 0.1 * (g - mean)
                square += 0.001 * (g * g - square)
                network.p[name] -= (rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
            pairs = ((network.words, vocabulary.word[own], d_x[:, :EMBED] * heard, seen[0]),
                     (network.grams, gram[spans], (d_x[:, EMBED:] / lengths[:, None])[of] * known[spans], seen[1]))
            for table, rows, g, past in pairs:
                kept, back = np.unique(rows, return_inverse=True)
                total = np.zeros((len(kept), EMBED), np.float32)
                np.add.at(total, back, g)
                past[kept, 0] += (total * total).mean(axis=1)
                table[kept] -= 10 * rate * total / np.sqrt(past[kept])
    return network


def regression(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.concatenate((features, np.ones((len(features), 1))), axis=1)
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        penal = ridge * np.append(np.ones(len(beta) - 1), 1e-6)
        gradient = x.T @ (weights * (chance - labels)) + penal * beta
        curve = (x * (weights * np.maximum(chance * (1 - chance), 1e-6))[:, None]).T @ x + np.diag(penal)
        beta -= np.linalg.solve(curve, gradient)
    return beta


class Model:
    """A network, the regression over its windows' logits, and the share of toxic labels."""

    def __init__(self, network: Network | None, beta: np.ndarray, prior: float):
        self.network, self.beta, self.prior = network, beta, prior

    def scores(self, column: pa.Array) -> list[float]:
        if self.network is None:
            return [self.prior] * len(column)
        out = []
        for logits in text_logits(column, self.network):
            value = float(np.dot(self.beta, [*summary(logits), 1.0])) if len(logits) else None
            out.append(self.prior if value is None else float(1 / (1 + np.exp(-np.clip(value, -30, 30)))))
        return out


def _windows(column: pa.Array, draws: list[float]) -> list[list[str]]:
    """At most ``WINDOWS_EACH`` windows of each text, as lower-case words joined by blanks, chosen by the text's own number."""
    out = []
    for words in shingles.chunks(pc.utf8_lower(column), BETWEEN):
        for a, b in zip(words.places[:-1], words.places[1:]):
            starts = a + window_starts(b - a)
            draw = np.random.default_rng(int(draws[len(out)] * (1 << 52)))
            if len(starts) > WINDOWS_EACH:
                starts = draw.choice(starts, WINDOWS_EACH, replace=False)
            out.append([b" ".join(words.data[words.starts[i]:words.ends[i]].tobytes() for i in range(s, min(s + WINDOW, b))).decode("utf-8", "replace")
                        for s in starts])
    return out


def fit(docs: DataFrame, labels: DataFrame, learns: Column, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """A model of the labelled documents for which ``learns`` holds. ``labels`` has ``doc_id`` and ``toxic``.

    Of a document with several labels the largest counts.
    """
    small_batches(docs.sparkSession)
    known = labels.filter("toxic in (0, 1)").groupBy(F.col("doc_id").alias("_l")).agg(F.max("toxic").cast("int").alias("_y"))
    numbers = known.join(docs.filter(learns).select(F.col("doc_id").cast("long").alias("_l")), "_l").groupBy("_y").count().collect()
    count = {r[0]: r[1] for r in numbers}
    total = sum(count.values())
    prior = count.get(1, 0) / total if total else 0.0
    if len(count) < 2:
        return Model(None, np.zeros(5), prior)
    u = unit_interval(F.xxhash64(F.lit(99), "_l"))
    share = {1: min(1.0, most_toxic / FOR_NETWORK / count[1]), 0: min(1.0, most_clean / FOR_NETWORK / count[0])}
    chosen = known.withColumn("_u", u).filter(F.when(F.col("_y") == 1, F.col("_u") < share[1]).otherwise(F.col("_u") < share[0]))
    sample = docs.filter(learns).select(F.col("doc_id").cast("long").alias("_l"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "_l")

    def for_network(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(_windows(batch.column(1), draws), pa.list_(pa.string()))], ["y", "u", "windows"])

    split = F.col("_u") * F.when(F.col("_y") == 1, 1 / share[1]).otherwise(1 / share[0])
    first = sample.filter(split < FOR_NETWORK).select("_y", "text", "_u").mapInArrow(for_network, "y int, u double, windows array<string>").collect()
    first.sort(key=lambda r: (r.u, r.windows))
    flat = [(w, r.y, i) for i, r in enumerate(first) for w in r.windows]
    if len({y for _, y, _ in flat}) < 2:
        return Model(None, np.zeros(5), prior)
    network = train([f[0] for f in flat], np.array([f[1] for f in flat], np.float32), np.array([f[2] for f in flat]))

    def for_regression(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [summary(x) if len(x) else None for x in text_logits(batch.column(1), network)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["y", "x"])

    second = [r for r in sample.filter(split >= FOR_NETWORK).select("_y", "text").mapInArrow(for_regression, "y int, x array<double>").collect() if r.x]
    second.sort(key=lambda r: (r.x, r.y))
    if len({r.y for r in second}) < 2:
        return Model(None, np.zeros(5), prior)
    y = np.array([r.y for r in second], float)
    weights = np.where(y == 1, count[1] / max(1, y.sum()), count[0] / max(1, (1 - y).sum())) / total * len(y)
    return Model(network, regression(np.array([r.x for r in second]), y, weights), prior)


def held_out() -> Column:
    """Rows whose labels no model learns from: those whose checksum of the id is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.scores(batch.column(2)), pa.float64())], ["doc_id", "held_out", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = source.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled documents that are not held out, and scores every document."""
    return score(docs, fit(docs, labels, ~held_out()))
