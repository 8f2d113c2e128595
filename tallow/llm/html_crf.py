"""Main-text extraction by a linear-chain conditional random field over leaf blocks.

Labels are boilerplate (0) and main text (1).  Weights of binary features, of
the two start labels and of the four transitions are fitted on labelled pages
by stochastic gradients of the log-likelihood, and pages are decoded by
Viterbi's algorithm inside Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallow.llm.html_blocks import Block, blocks, features
from tallow.llm.html_pages import labelled

#: Labelled pages that are made for training, and passes over them.
TRAINING_PAGES, PASSES = 500, 6


class Crf:
    def __init__(self, index: dict[str, int], weight: np.ndarray, start: np.ndarray, move: np.ndarray):
        self.index, self.weight, self.start, self.move = index, weight, start, move

    def scores(self, page: list[list[str]]) -> np.ndarray:
        """(blocks, 2): what each block's known features say for either label."""
        get, weight = self.index.get, self.weight
        return np.array([weight[[k for k in map(get, f) if k is not None]].sum(0) for f in page])

    def decode(self, page: list[list[str]]) -> list[int]:
        """The most likely labels."""
        if not page:
            return []
        each = self.scores(page).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        s0, s1 = (a + b for a, b in zip(self.start.tolist(), each[0]))
        back: list[tuple[int, int]] = []
        for e0, e1 in each[1:]:
            b0, b1 = int(s1 + m10 > s0 + m00), int(s1 + m11 > s0 + m01)
            s0, s1 = (s1 + m10 if b0 else s0 + m00) + e0, (s1 + m11 if b1 else s0 + m01) + e1
            back.append((b0, b1))
        label = int(s1 > s0)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def _marginals(each: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of labels (n, 2) and of label pairs summed over places (2, 2), by forward and backward passes."""
    n = len(each)
    fwd, bwd = np.empty((n, 2)), np.zeros((n, 2))
    fwd[0] = start + each[0]
    for i in range(1, n):
        fwd[i] = np.logaddexp(fwd[i - 1, 0] + move[0], fwd[i - 1, 1] + move[1]) + each[i]
    for i in range(n - 2, -1, -1):
        step = move + each[i + 1] + bwd[i + 1]
        bwd[i] = np.logaddexp(step[:, 0], step[:, 1])
    total = np.logaddexp(*fwd[-1])
    pairs = np.exp(fwd[:-1, :, None] + move + (each[1:] + bwd[1:])[:, None, :] - total).sum(0) if n > 1 else np.zeros((2, 2))
    return np.exp(fwd + bwd - total), pairs


def train(pages: list[tuple[list[list[str]], list[int]]], passes: int = PASSES, rate: float = 0.15, decay: float = 1e-4, seed: int = 1) -> Crf:
    """A field fitted to (features of the blocks, labels) of pages, with Adagrad steps page by page."""
    index: dict[str, int] = {}
    for page, _ in pages:
        for f in page:
            for x in f:
                index.setdefault(x, len(index))
    weight, start, move = np.zeros((len(index), 2)), np.zeros(2), np.zeros((2, 2))
    square = [np.full_like(x, 1e-2) for x in (weight, start, move)]
    rng = np.random.default_rng(seed)
    coded = [([np.array([index[x] for x in f]) for f in page], np.array(y)) for page, y in pages if page]
    for _ in range(passes):
        for k in rng.permutation(len(coded)).tolist():
            page, y = coded[k]
            each = np.array([weight[f].sum(0) for f in page])
            prob, pairs = _marginals(each, start, move)
            gap = np.eye(2)[y] - prob
            met = np.zeros((2, 2))
            np.add.at(met, (y[:-1], y[1:]), 1)
            flat = np.concatenate(page)
            rows, back = np.unique(flat, return_inverse=True)
            grad = np.zeros((len(rows), 2))
            np.add.at(grad, back, np.repeat(gap, [len(f) for f in page], axis=0))
            grad -= decay * weight[rows]
            square[0][rows] += grad**2
            weight[rows] += rate * grad / np.sqrt(square[0][rows])
            for x, g, s in ((start, gap[0], square[1]), (move, met - pairs, square[2])):
                s += g**2
                x += rate * g / np.sqrt(s)
    return Crf(index, weight, start, move)


def marked(html: str, texts: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a labelled page; texts as labelled() gives them."""
    page = blocks(html)
    main = {" ".join(t[1:].split()) for t in texts if t[0] == "+"}
    return features(page), [int(b.text in main) for b in page]


@lru_cache(maxsize=1)
def trained() -> Crf:
    """The field fitted on TRAINING_PAGES made pages."""
    return train([marked(*p) for p in labelled(TRAINING_PAGES)])


def main_text(html: str | None, crf: Crf) -> str:
    page: list[Block] = blocks(html) if html else []
    return " ".join(b.text for b, y in zip(page, crf.decode(features(page))) if y)


def _text_rows(crf, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = crf.value
        for batch in batches:
            step = 256
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                texts = [main_text(x.as_py(), field) for x in part.column(at)]
                cols = [c for k, c in enumerate(part.columns) if k != at]
                names = [n for k, n in enumerate(part.schema.names) if k != at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return run


def extract(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """pages with text and n_chars in place of html.

    All rows and other columns stay (those named text or n_chars are
    replaced).  A null, empty or text-free page gives an empty text; repeated
    rows give equal texts; an empty table gives an empty one.
    """
    pages = pages.drop("text", "n_chars")
    crf = crf or trained()
    schema = T.StructType([*[f for f in pages.schema.fields if f.name != "html"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.mapInArrow(_text_rows(pages.sparkSession.sparkContext.broadcast(crf), pages.columns.index("html")), schema)
