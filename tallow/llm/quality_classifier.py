"""Quality scores learned from positive and unlabelled texts.

Trusted positives and unlabelled web text of an estimated class prior train a
linear model on binned text statistics by minimising the non-negative
unbiased risk: ``pi R+_p + max(0, R-_u - pi R-_p)``, with the step reversed
where the part in brackets falls below zero (Kiryo et al. 2017).  Labelled
rows are a bounded, documented sample, unlabelled rows all teach; every text
is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm import scratch
from tallow.llm.textbatch import ALNUM, NOT_SPACE, Words, chunks

#: Labelled positives that the weights are fitted on at most: those of least hash.  Unlabelled rows all count.
SAMPLE = 20_000
#: Newton steps of a fit at most, the pull of weights to 0, and the furthest that a weight goes in a step.
STEPS, DECAY, LONGEST = 10, 1e-3, 3.0
#: Groups in which the sums of tasks are put together before they meet at the driver.
GROUPS = 16
#: Score bins in which positives and unlabelled rows are counted for the class prior.
GRID = 2000
NAMES = ("n_words", "word_len", "symbols", "upper", "digits", "marks", "pipes", "distinct", "repeats", "top_word", "lines", "far", "bare", "shouts")
BINS = 12

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&<>|@^~\\{}[]=+_")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, len(NAMES)) numbers, each from the whole text; none depends on labels or sources."""
    out = []
    for _, data, offs in chunks(texts):
        n = len(offs) - 1
        size = np.maximum(np.diff(offs), 1)
        owner = np.repeat(np.arange(n), np.diff(offs))
        share = lambda mask: np.bincount(owner[mask], minlength=n) / size  # noqa: E731, B023
        words, low = Words(data, offs, NOT_SPACE), Words(data, offs, ALNUM)
        count = np.maximum(words.count, 1)
        per_word = lambda mask: np.bincount(words.doc[mask], minlength=n) / count  # noqa: E731, B023
        length = words.end - words.start
        pair = np.zeros(len(words.hash), bool)
        pair[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        order = np.lexsort((low.hash, low.doc))
        h, d = low.hash[order], low.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        width = np.diff(np.append(first, len(h)))
        top = np.zeros(n)
        np.maximum.at(top, d[first], width)
        kinds = np.bincount(d[first], minlength=n)
        own = np.maximum(low.count, 1)
        last = data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
        before = data[np.maximum(words.end - 2, 0)] if len(words.end) else last
        out.append(
            np.column_stack(
                [
                    np.log1p(words.count), np.bincount(words.doc, weights=length, minlength=n) / count, share(_SYMBOL[data]), share(_UPPER[data]), share(_DIGIT[data]),
                    share(_MARK[data]), share(data == 124), kinds / np.sqrt(own), per_word(pair), top / own, np.bincount(owner[data == 10], minlength=n) / count,
                    share(data >= 128), 1 - per_word(_MARK[last] | (last == 34)), per_word((last == 33) & (before == 33)),
                ]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)))


def _statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(1))
        rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["doc_id", "x"])


class Model:
    """Bins of each statistic and a weight for each bin."""

    def __init__(self, cuts: list[np.ndarray], weight: np.ndarray, shift: float):
        self.cuts, self.weight, self.shift = cuts, weight, shift

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Column numbers of the one set bin of each statistic."""
        at = np.cumsum([0] + [len(c) + 1 for c in self.cuts[:-1]])
        return np.column_stack([a + np.searchsorted(c, x[:, k], "right") for k, (a, c) in enumerate(zip(at, self.cuts))])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.weight[self.bins(x)].sum(1) + self.shift if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.05) -> float:
    """Share of positives among the unlabelled, from the counts of both per score bin, lowest scores first.

    Wherever positives stand above a score, the unlabelled do so at least as
    often times the prior: the prior is at most the least ratio of the two
    shares above a threshold that leaves a share ``least`` of the positives,
    each with its deviation bound (Scott 2015).
    """
    n, m = positive.sum(), unlabelled.sum()
    if not n or not m:
        return 0.5
    above = lambda c: np.cumsum(c[::-1])[::-1] / c.sum()
    p, u = above(positive), above(unlabelled)
    eps = np.sqrt(np.log(200) / n) / 2 + np.sqrt(np.log(200) / m) / 2
    ratio = (u + eps) / np.maximum(p - eps, 1e-9)
    return float(np.clip(ratio[(p > 2 * eps) & (p >= least)].min(initial=1.0), 0.05, 0.98))


def grid(scores: np.ndarray) -> np.ndarray:
    """The score bin of each score."""
    return np.minimum((scores * GRID).astype(np.int64), GRID - 1)


class _Sums:
    """Loss of rows as negative at given weights, its gradient and its curvature, summed; n rows."""

    def __init__(self, size: int):
        self.n, self.loss, self.grad, self.hess = 0, 0.0, np.zeros(size), np.zeros((size, size))

    def add(self, bins: np.ndarray, theta: np.ndarray) -> None:
        size, z = len(theta), theta[bins].sum(1) + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        self.n, self.loss = self.n + len(z), self.loss + float(np.logaddexp(0, z).sum())
        columns = [*bins.T.astype(np.int64), np.full(len(z), size - 1)]
        for i, c in enumerate(columns):
            self.grad += np.bincount(c, weights=s, minlength=size)
            for j in range(i, len(columns)):
                part = np.bincount(c * size + columns[j], weights=s * (1 - s), minlength=size * size).reshape(size, size)
                self.hess += part if i == j else part + part.T

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.n]), pa.array([self.loss]), pa.array([self.grad.tobytes()], pa.binary()), pa.array([self.hess.tobytes()], pa.binary())], ["n", "loss", "grad", "hess"])

    def take(self, n: int, loss: float, grad: bytes, hess: bytes) -> None:
        self.n, self.loss = self.n + n, self.loss + loss
        self.grad, self.hess = self.grad + np.frombuffer(grad), self.hess + np.frombuffer(hess).reshape(self.hess.shape)


_SUMS = "n long, loss double, grad binary, hess binary"


def _all_sums(rows: DataFrame, theta: np.ndarray) -> _Sums:
    """The sums over all rows of bin numbers (part, bins): per task, then per group of tasks, then here."""
    size = len(theta)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, part = _Sums(size), 0
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.add(np.frombuffer(packed, np.int16).reshape(-1, len(NAMES)), theta)
        if sums.n:
            row = sums.row()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *row.columns], ["part", *row.schema.names])

    def together(table: pa.Table) -> pa.Table:
        sums = _Sums(size)
        for row in zip(*(table.column(c).to_pylist() for c in ("n", "loss", "grad", "hess"))):
            sums.take(*row)
        return pa.Table.from_batches([sums.row()])

    groups = rows.mapInArrow(each, "part long, " + _SUMS).withColumn("part", F.pmod("part", F.lit(GROUPS))).groupBy("part").applyInArrow(together, _SUMS)
    out = _Sums(size)
    for row in groups.collect():  # GROUPS at most
        out.take(*row)
    return out


def _minimise(theta: np.ndarray, positive: np.ndarray, rows: DataFrame, prior: float | None, steps: int = STEPS, decay: float = DECAY) -> np.ndarray:
    """Newton steps on the risk with logistic loss: plain positive against unlabelled, or with a prior the non-negative one.

    The unclipped risk is convex, for the positives' part of it is linear.  A
    step after which the part in brackets is negative is taken half back.
    """
    before = theta
    for _ in range(steps):
        u, p = _all_sums(rows, theta), _Sums(len(theta))
        p.add(positive, theta)
        x = np.bincount(positive.ravel(), minlength=len(theta)).astype(float)
        x[-1] = p.n
        if prior is None:
            grad, hess = (p.grad - x) / p.n + u.grad / u.n, p.hess / p.n + u.hess / u.n
        else:
            if u.loss / u.n < prior * p.loss / p.n:
                theta = (theta + before) / 2
                continue
            grad, hess = u.grad / u.n - prior * x / p.n, u.hess / u.n
        ridge = np.append(np.full(len(theta) - 1, decay), 1e-9)
        grad = grad + ridge * theta
        if np.abs(grad).max() < 1e-6:
            break
        move = np.linalg.solve(hess + np.diag(ridge), grad)
        before, theta = theta, theta - move * min(1.0, LONGEST / np.abs(move).max())
    return theta


def _score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2)
            flat = np.asarray(x.flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.value.score(flat))], ["doc_id", "held_out", "score"])

    return run


def _least(stats: DataFrame, sample: int) -> list[DataFrame]:
    """The ``sample`` rows of least hash of kind 0 and of kind 1 of stats (kind, h, doc_id, x).

    Counts per kind and leading bits of the hash say below which hash these
    rows stand, so that about as many and no more come to the driver.
    """
    lead = F.shiftright("h", 52)  # 4096 values in all
    counts = sorted(tuple(r) for r in stats.groupBy("kind", lead.alias("lead")).count().collect())
    cut, seen = {}, {}
    for kind, at, n in counts:
        if seen.get(kind, 0) < sample:
            cut[kind] = at
        seen[kind] = seen.get(kind, 0) + n
    near = F.lit(False)
    for kind, at in cut.items():
        near = near | ((F.col("kind") == kind) & (lead <= at))
    return [stats.where(near & (F.col("kind") == kind)).orderBy("h", "doc_id", "x").limit(sample) for kind in (0, 1)]


def _cuts(rows: DataFrame) -> list[np.ndarray]:
    """Inner edges of the bins of each statistic, by quantiles of all rows; rare extremes, where junk is found, get bins of their own."""
    shares = sorted({*np.linspace(0, 1, BINS + 1)[1:-1].tolist(), 0.005, 0.02, 0.05, 0.95, 0.98, 0.995})
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(k)), F.array(*map(F.lit, shares)), 10_000).alias(f"q{k}") for k in range(len(NAMES))]).first()
    return [np.unique(q) for q in found]


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model, float]:
    """(model, class prior) from stats (doc_id, held_out, x).

    Of the labelled positives a bounded sample teaches; bins, class prior and
    every step of the weights go over all unlabelled rows.
    """
    spark = stats.sparkSession
    # Labels grow with the corpus: joined by shuffle, of keys and statistics only.
    known = labels.where("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").hint("merge")
    kind = F.when(F.col("quality").isNull(), 0).when(F.col("quality") == 1, 1).alias("kind")
    taught = stats.where("NOT held_out").join(known, "doc_id", "left").select(kind, F.xxhash64("doc_id").alias("h"), "doc_id", "x").where("kind IS NOT NULL")
    taught = scratch.table(taught, "taught")
    p = np.array([r[0] for r in _least(taught, sample)[1].select("x").collect()]).reshape(-1, len(NAMES))
    if not len(p) or not taught.where("kind = 0").limit(1).count():
        return Model([np.zeros(0)] * len(NAMES), np.zeros(len(NAMES)), 0.0), 0.5
    cuts = _cuts(taught)
    model = Model(cuts, np.zeros(sum(len(c) + 1 for c in cuts)), 0.0)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([model.bins(x).astype(np.int16).tobytes()], pa.binary())], ["part", "bins"])

    rows = scratch.table(taught.where("kind = 0").select("x").mapInArrow(packed, "part long, bins binary"), "bins")
    positive = model.bins(p)
    theta = _minimise(np.zeros(len(model.weight) + 1), positive, rows, None)
    model.weight, model.shift = theta[:-1], float(theta[-1])
    shared = spark.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grid(shared.value.score(x)))], ["kind", "bin"])

    counts = np.zeros((2, GRID))
    for k, b, n in taught.select("kind", "x").mapInArrow(bins, "kind int, bin long").groupBy("kind", "bin").count().collect():
        counts[k, b] = n
    prior = class_prior(counts[1], counts[0])
    theta = _minimise(theta, positive, rows, prior)
    return Model(cuts, theta[:-1], float(theta[-1])), prior


def score(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text, ...).

    held_out rows (crc32 of doc_id as text divisible by five) teach nothing.
    Positives are the others labelled quality 1, of which the ``sample`` rows of
    least hash teach; unlabelled are those without a label, which all do.  A document labelled twice counts twice; a
    null or empty text has the statistics of no words; a null doc_id is scored
    and not held out; empty tables give an empty result or scores of one half.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = texts.mapInArrow(_statistic_rows, "doc_id long, x array<double>")
    stats = scratch.table(stats.select("doc_id", out.alias("held_out"), "x"), "statistics")
    model, _ = fit(stats, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = stats.mapInArrow(_score_rows(shared), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
