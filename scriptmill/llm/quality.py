"""Quality of texts by naive Bayes support vectors: indicators of n-grams, scaled by the log-count ratios of the classes,
in a linear model with hinge loss that dual coordinate descent fits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.llm import textkit
from scriptmill.llm.common import Stored, ready

# Hash buckets of the n-grams, and rows that the support vector model is fitted on (a sample by hash; the ratios count all
# labelled rows). Both bound what reaches the driver.
BITS, FIT_ROWS = 18, 8192
EPOCHS, COST, SMOOTHING = 20, 1.0, 1.0
BROADCAST_LABELS = 1_000_000

_CLASS = np.arange(256, dtype=np.uint8)  # letters and digits by kind, any other byte as itself
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3


def _shapes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the shape of each word: runs of capitals, of other letters and of digits count once, signs one by one."""
    kind = _CLASS[raw]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | (kind[1:] > 3)
    keep[start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    first = np.zeros(len(kind), np.int64)
    first[start] = at[start]
    place = np.arange(at[-1]) - np.maximum.accumulate(first)[keep]  # number of the sign in its word
    value = textkit.mix64(kind[keep].astype(np.uint64) + place.astype(np.uint64) * np.uint64(256))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    return textkit.mix64(total[at[end]] - total[at[start]])


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of every text (flat, with offsets): words and pairs of words; shapes of words with a mark
    on repeats, singly, in pairs and in threes; and which shapes make up a twentieth, a fifth or half of the words."""
    raw, offsets = textkit.buffers(column)
    start, end, word, rows = textkit.words(raw, offsets)
    n = len(rows) - 1
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(rows))
    shape = _shapes(raw, start, end)
    again = np.zeros(len(word), np.uint64)
    if len(word) > 1:
        again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    shape = textkit.mix64(shape + again)
    out = []

    def add(hashes: np.ndarray, owners: np.ndarray, kind: int) -> None:
        bucket = textkit.mix64(hashes + np.uint64(kind)) >> np.uint64(64 - BITS)
        out.append(owners << np.uint64(BITS) | bucket)

    for kind, (tokens, width) in enumerate([(word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3)]):
        if len(tokens) >= width:
            whole = owner[: len(tokens) - width + 1] == owner[width - 1 :]
            add(textkit.runs(tokens, width)[whole], owner[: len(whole)][whole], kind)
    if len(word):
        pair, count = np.unique(np.stack([owner, shape], axis=1), axis=0, return_counts=True)
        share = count / np.diff(rows)[pair[:, 0].astype(int)]
        for kind, least in enumerate((0.05, 0.2, 0.5)):
            add(pair[share >= least, 1], pair[share >= least, 0], 16 + kind)
    flat = np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)
    cut = np.searchsorted(flat, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS))
    return (flat & np.uint64((1 << BITS) - 1)).astype(np.int64), cut


@dataclass
class Model:
    """Log-count ratios, weights times ratios, bias, and the line that turns a margin into log odds."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, flat: np.ndarray, cut: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weight[flat])])
        square = np.concatenate([[0.0], np.cumsum(self.ratio[flat] ** 2)])
        length = np.sqrt(np.maximum(square[cut[1:]] - square[cut[:-1]], 1e-12))
        return (total[cut[1:]] - total[cut[:-1]]) / length + self.bias

    def scores(self, flat: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(flat, cut) + self.shift, -50, 50)))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, dims: int, epochs: int,
            seed: int = 1) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: one multiplier per row, each set to its optimum in turn, the weights
    kept up to date. Rows are sparse and of length one, plus the bias."""
    w, bias, alpha = np.zeros(dims), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i], values[i]
            gradient = y[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def _line(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log odds by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(g * margin).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", fit_rows: int = FIT_ROWS) -> Model | None:
    """Learn from the rows whose id is not held out; none if they do not hold both classes.

    The counts behind the ratios cover every labelled row outside the held-out fold. The support vector model is fitted on
    ``fit_rows`` of them at most, those with the smallest hashes of their ids; a fifth of these sets the odds."""
    ready(spark)
    store = Stored(spark)
    marked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("q")).filter(
        F.col("id").isNotNull() & F.col("q").isNotNull() & ~held_out(F.col("id")))
    marked = marked.groupBy("id").agg(F.avg("q").alias("q")).filter("q <> 0.5")
    marked = store.keep(marked.select("id", (F.col("q") > 0.5).cast("int").alias("y")))
    n = marked.count()
    if not n:
        return None
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    side = F.broadcast(marked) if n <= BROADCAST_LABELS else marked
    learn = texts.join(side, F.col("doc_id") == F.col("id")).select("y", "text")
    dims = 1 << BITS

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros((2, dims), np.int64)
        for batch in textkit.batched(batches):
            y = np.asarray(batch.column(0))
            flat, cut = features(batch.column(1))
            mine = np.repeat(y, np.diff(cut))
            for k in (0, 1):
                sums[k] += np.bincount(flat[mine == k], minlength=dims)
        hit = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(sums[0][hit]), pa.array(sums[1][hit])],
                                         ["f", "n0", "n1"])

    counted = learn.mapInArrow(count, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counted.toArrow()
    f, n0, n1 = (np.asarray(counts.column(c).combine_chunks()) for c in ("f", "n0", "n1"))
    p, q = np.full(dims, SMOOTHING), np.full(dims, SMOOTHING)
    p[f] += n1
    q[f] += n0
    if not n0.sum() or not n1.sum():
        return None
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())

    rank = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    few = marked.filter(rank < int(min(1.0, 1.2 * fit_rows / n) * (1 << 40))).orderBy(rank, "id").limit(fit_rows)
    sample = texts.join(F.broadcast(few), F.col("doc_id") == F.col("id")).select("doc_id", "y", "text")

    def sparse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in textkit.batched(batches):
            flat, cut = features(batch.column(2))
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "y", "f"])

    got = sample.mapInArrow(sparse, "doc_id long, y int, f array<int>").toArrow()
    ids = np.asarray(got.column("doc_id").combine_chunks())
    y = np.where(np.asarray(got.column("y").combine_chunks()) > 0, 1.0, -1.0)
    lists = got.column("f").combine_chunks()
    flat, at = np.asarray(lists.flatten()), np.asarray(lists.offsets)
    order = np.lexsort((at[1:] - at[:-1], ids))
    rows = [flat[at[i] : at[i + 1]] for i in order]
    y = y[order]
    store.drop()
    values = [ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-6) for r in rows]
    share = {s: max(1, (y == s).sum()) for s in (1.0, -1.0)}
    cost = np.array([COST * len(y) / (2 * share[s]) for s in y])
    part = np.arange(len(y)) % 5 == 0
    if len(set(y[~part])) < 2 or len(set(y[part])) < 2:
        part[:] = False
    use = np.flatnonzero(~part)
    w, bias = descend([rows[i] for i in use], [values[i] for i in use], y[use], cost[use], dims, EPOCHS)
    model = Model(ratio, w * ratio, bias, 1.0, 0.0)
    check = np.flatnonzero(part) if part.any() else use
    cut = np.concatenate([[0], np.cumsum([len(rows[i]) for i in check])])
    model.slope, model.shift = _line(model.margins(np.concatenate([rows[i] for i in check]), cut), y[check])
    return model


def score(spark: SparkSession, model: Model | None, text: str = "text") -> Column:
    """The score of a text, 0 to 1; 0.5 for all texts if nothing could be learnt."""
    if model is None:
        return F.lit(0.5).cast("double")
    shared = spark.sparkContext.broadcast((model.ratio, model.weight, model.bias, model.slope, model.shift))

    @F.arrow_udf("double")
    def scored(column):
        import pyarrow as pa

        return pa.array(Model(*shared.value).scores(*features(column)))

    return scored(F.coalesce(F.col(text), F.lit("")))


def with_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, and __score (double) and __predicted (1 if the score is 0.5 or more).

    Only the text is looked at. Nulls: a null text counts as empty; an empty text has no features and the score of the
    bias; rows without an id are scored but never learnt from. Labels that are null are left out, several labels of an id
    are averaged and left out if undecided. Repeated rows are scored alike. Without labels of both classes every score is
    0.5. An empty table gives an empty result."""
    ready(spark)
    model = fit(spark, docs, labels, doc_id, text)
    out = docs.withColumn("__score", score(spark, model, text))
    return out.withColumn("__predicted", (F.col("__score") >= 0.5).cast("int"))
