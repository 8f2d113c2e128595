"""Texts scored by a hierarchical Pitman-Yor model of word pairs.

Every word is a context with a restaurant; its customers are the words that
follow it, and each of its tables is a customer of the one parent that all
contexts share, the restaurant of single words.  The parent's base is uniform
over the training words and one class for all others.  How many tables a
context has for a word is sampled by Gibbs sweeps; a text's score is the sum of
the logarithms of predictive probabilities averaged over the sweeps behind the
burn-in.

A sweep draws the whole seating of a (context, word) cell at once, given the
last sweep's seating of all others: t tables of c customers have weight
S(c, t) a^t, S being the generalised Stirling numbers of the discount and a the
chance of a new table without this cell.  That is exact to EXACT customers; the
customers beyond join in blocks that double, a block's new tables being drawn
from their mean under the seating rule.  All cells of a sweep are drawn from
the sweep before, as in other distributed Gibbs samplers.  Draws depend on the
cell and the sweep alone, so that results don't depend on how rows are dealt,
and a seating is made again where it is needed instead of being stored.

The corpus is read once.  A task makes chunks of texts, each with its sorted
distinct words; what a chunk needs to know of words and pairs it asks from
tables dealt by ranges of their hashes, in packed arrays of sorted keys, and a
chunk has a key once, however often it occurs.  The counts gather all of the
training texts.  Words and pairs are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm import scratch
from tallow.llm.textbatch import NOT_SPACE, Words, chunks, mix

#: Bytes of text of a chunk, and keys of a bucket, about.
CHUNK = 5 << 20
BUCKET_KEYS = 1 << 20
#: Bytes of text whose words are hashed at once.
HASHED = 1 << 20
#: Pairs whose probabilities a task works out at once.
BLOCK = 1 << 17
#: Customers of a cell whose seating is drawn exactly.
EXACT = 32
SWEEPS, BURN_IN = 3, 1
#: Strengths of the contexts and of their parent.
STRENGTH, PARENT_STRENGTH = 1.0, 1.0

#: The end of a text as a word, and its beginning as a context.
END, BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)

_SLICE = "chunk long, bucket int, keys binary, cols array<binary>"
_WORDS = "bucket int, keys binary, cols array<binary>, nums array<long>"


def packed(a: np.ndarray, sorted_keys: bool = False) -> bytes:
    """An array as bytes: differences if sorted, then byte by byte of all numbers, compressed."""
    if sorted_keys:
        a = np.diff(a, prepend=np.zeros(1, a.dtype))
    return len(a).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), codec="zstd", asbytes=True) if len(a) else bytes(8)


def unpacked(b: bytes, kind: type = np.int64, sorted_keys: bool = False) -> np.ndarray:
    n, wide = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=n * wide, codec="zstd"), np.uint8)
    a = np.ascontiguousarray(planes.reshape(wide, n).T).view(kind).ravel()
    return np.cumsum(a, dtype=kind) if sorted_keys else a


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context ^ np.uint64(0xA0761D6478BD642F)) + word)


def _uniform(keys: np.ndarray, sweep: int, draw: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        salt = np.array([sweep * 64 + draw + 1], np.uint64) * np.uint64(0xE7037ED1A0B428DB)
    return (mix(keys ^ mix(salt)) >> np.uint64(11)).astype(float) / (1 << 53)


def stirling_logs(discount: float, n: int = EXACT) -> np.ndarray:
    """ln S(c, t) for c, t up to n: S(c + 1, t) = S(c, t - 1) + (c - discount t) S(c, t)."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0
    for c in range(n):
        for t in range(1, c + 2):
            stay = c - discount * t
            out[c + 1, t] = np.logaddexp(out[c, t - 1], out[c, t] + math.log(stay) if stay > 0 and t <= c else -np.inf)
    return out


def seat(c: np.ndarray, chance: np.ndarray, discount: float, keys: np.ndarray, sweep: int, logs: np.ndarray) -> np.ndarray:
    """Tables of cells with c customers, where a customer's new table has weight chance and its old ones c - discount t."""
    out = np.minimum(c, 1)
    small = np.minimum(c, EXACT)
    order = np.argsort(small, kind="stable")
    cuts = np.searchsorted(small[order], np.arange(2, EXACT + 2))
    ln, u = np.log(np.maximum(chance, 1e-300)), _uniform(keys, sweep, 0)
    for size, a, b in zip(range(2, EXACT + 1), cuts, cuts[1:]):
        if a < b:
            at = order[a:b]
            w = logs[size, 1 : size + 1] + ln[at, None] * np.arange(size)
            w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), 1)
            out[at] = 1 + (w < u[at, None] * w[:, -1:]).sum(1)
    far = np.flatnonzero(c > EXACT)
    k, block = np.full(len(far), EXACT, np.int64), 1
    while len(far):
        m, left = np.minimum(k, c[far] - k), k - discount * out[far]
        mean = np.minimum(chance[far] * np.log((chance[far] + left + m) / (chance[far] + left)), m)
        angle, size = 2 * np.pi * _uniform(keys[far], sweep, 3 * block), np.sqrt(-2 * np.log1p(-_uniform(keys[far], sweep, 3 * block + 1)))
        more = np.floor(mean + np.sqrt(mean * (1 - mean / m)) * size * np.cos(angle) + _uniform(keys[far], sweep, 3 * block + 2))
        out[far] += np.clip(more, 0, m).astype(np.int64)
        k, block = k + m, block + 1
        on = k < c[far]
        far, k = far[on], k[on]
    return out


class Model:
    """Discounts, strengths and the parent's totals by sweep; what probabilities take beside a cell's own numbers."""

    def __init__(self, vocabulary: int, discount: float, parent_discount: float):
        self.v, self.d, self.d0 = vocabulary, discount, parent_discount
        self.customers: list[int] = []
        self.tables: list[int] = []

    def parent(self, s: int, customers: np.ndarray, tables: np.ndarray, less: np.ndarray | int = 0) -> np.ndarray:
        """P(word) in the parent after sweep s; less: customers that are left out."""
        left = np.maximum(customers - less, 0)
        new = (PARENT_STRENGTH + self.d0 * self.tables[s]) / (self.v + 1)
        return (left - self.d0 * np.minimum(tables, left) + new) / (PARENT_STRENGTH + np.maximum(self.customers[s] - less, 0))

    def parent_chance(self, s: int) -> float:
        """Weight of a new table of one word in the parent."""
        return (PARENT_STRENGTH + self.d0 * self.tables[s]) / (self.v + 1)

    def seatings(self, sweeps: int, c: np.ndarray, keys: np.ndarray, context: list[np.ndarray], customers: list[np.ndarray], tables: list[np.ndarray]) -> list[np.ndarray]:
        """Tables of cells after sweeps 0 to sweeps; context[s]: the context's tables, customers[s] and tables[s]: the word's in the parent."""
        logs, out = stirling_logs(self.d), [np.minimum(c, 1)]
        many = np.flatnonzero(c > 1)
        for s in range(sweeps):
            own = out[-1][many]
            chance = (STRENGTH + self.d * np.maximum(context[s][many] - own, 0)) * self.parent(s, customers[s][many], tables[s][many], own)
            t = out[0].copy()
            t[many] = seat(c[many], chance, self.d, keys[many], s + 1, logs)
            out.append(t)
        return out


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


# Chunks of texts.


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, train, text) to chunks: their texts, sorted distinct words with training counts, and words by place among these."""
    task, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at, _, offs in chunks(batch.column(2), CHUNK):
            n = len(offs) - 1
            parts = [(w.count, w.hash) for w in (Words(d, o, NOT_SPACE) for _, d, o in chunks(batch.column(2).slice(at, n), HASHED))]
            sizes = np.concatenate([count for count, _ in parts]) + 1
            word = np.ones(int(sizes.sum()), bool)
            word[np.cumsum(sizes) - 1] = False
            stream = np.full(len(word), END, np.uint64)
            stream[word] = np.concatenate([h for _, h in parts])
            del parts, word
            train = batch.column(1).slice(at, n).to_numpy(zero_copy_only=False).astype(bool)
            keys, place = np.unique(np.concatenate([stream, [BEGIN]]), return_inverse=True)
            count = np.bincount(place[:-1], weights=np.repeat(train, sizes), minlength=len(keys)).astype(np.int64)
            count[place[-1]] = train.sum()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task << 32 | serial], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0).slice(at, n)),
                    pa.array([packed(train.astype(np.int64))], pa.binary()),
                    pa.array([packed(sizes)], pa.binary()),
                    pa.array([packed(keys, True)], pa.binary()),
                    pa.array([packed(count)], pa.binary()),
                    pa.array([packed(place[:-1].astype(np.int32))], pa.binary()),
                    pa.array([len(keys)], pa.int64()),
                    pa.array([len(stream)], pa.int64()),
                ],
                ["chunk", "doc_ids", "train", "sizes", "keys", "counts", "words", "n_keys", "n_words"],
            )
            serial += 1


class Pairs:
    """The distinct pairs of a chunk in the order of their keys, and each word's pair."""

    def __init__(self, keys: np.ndarray, words: np.ndarray, sizes: np.ndarray, train: np.ndarray):
        self.first = np.cumsum(sizes) - sizes
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[self.first] = np.searchsorted(keys, BEGIN)
        self.keys, index, self.pair = np.unique(pair_keys(keys[before], keys[words]), return_index=True, return_inverse=True)
        self.context, self.word = before[index], words[index]
        self.count = np.bincount(self.pair, weights=np.repeat(train, sizes), minlength=len(self.keys)).astype(np.int64)

    @staticmethod
    def of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, Pairs]:
        keys, words, sizes, train = unpacked(row["keys"], np.uint64, True), unpacked(row["words"], np.int32), unpacked(row["sizes"]), unpacked(row["train"])
        return keys, words, sizes, Pairs(keys, words, sizes, train)


# Exchanges between chunks and buckets of keys.


def _slices(chunk: int, keys: np.ndarray, buckets: int, cols: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket that keys, sorted, fall into."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(keys)]
    spans = list(zip(cuts, cuts[1:]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([chunk] * len(spans), pa.int64()),
            pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
            pa.array([packed(keys[a:b], True) for a, b in spans], pa.binary()),
            pa.array([[packed(c[a:b]) for c in cols] for a, b in spans], pa.list_(pa.binary())),
        ],
        ["chunk", "bucket", "keys", "cols"],
    )


class _Bucket:
    """The slices of one bucket, one after the other in the order of their chunks."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("chunk")
        self.chunk = table.column("chunk").to_pylist()
        parts = [unpacked(k, np.uint64, True) for k in table.column("keys").to_pylist()]
        self.ends = np.cumsum([0, *map(len, parts)])
        self.keys = np.concatenate([np.zeros(0, np.uint64), *parts])
        self._cols = table.column("cols").to_pylist()

    def col(self, k: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[unpacked(c[k]) for c in self._cols]])

    def replies(self, bucket: int, cols: list[np.ndarray]) -> pa.Table:
        """cols, aligned with keys, cut back into slices."""
        spans = list(zip(self.ends, self.ends[1:]))
        return pa.table(
            {
                "chunk": pa.array(self.chunk, pa.int64()),
                "bucket": pa.array([bucket] * len(spans), pa.int32()),
                "keys": pa.array([None] * len(spans), pa.binary()),
                "cols": pa.array([[packed(c[a:b]) for c in cols] for a, b in spans], pa.list_(pa.binary())),
            }
        )


def _joined(table: pa.Table) -> list[np.ndarray]:
    """The columns of all replies to a chunk, in the order of its keys."""
    rows = table.sort_by("bucket").column("cols").to_pylist()
    return [np.concatenate([unpacked(r[k]) for r in rows]) for k in range(len(rows[0]))] if rows else []


def _words_row(bucket: int, keys: np.ndarray, cols: list[np.ndarray], nums: list[int]) -> pa.Table:
    return pa.table(
        {
            "bucket": pa.array([bucket], pa.int32()),
            "keys": pa.array([packed(keys, True)], pa.binary()),
            "cols": pa.array([[packed(c) for c in cols]], pa.list_(pa.binary())),
            "nums": pa.array([[int(x) for x in nums]], pa.list_(pa.int64())),
        }
    )


def _lexicon_slices(buckets: int, with_counts: bool):
    def run(batches):
        for batch in batches:
            for chunk, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                yield _slices(chunk, unpacked(keys, np.uint64, True), buckets, [unpacked(counts)] if with_counts else [])

    return run


def _pair_slices(buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pairs = Pairs.of(row)[3]
                yield _slices(row["chunk"], pairs.keys, buckets, [pairs.count])

    return run


def _count_words(key: tuple, table: pa.Table) -> pa.Table:
    """Training counts of a bucket's words; words without any are left out."""
    got = _Bucket(table)
    keys, back = np.unique(got.keys, return_inverse=True)
    n = np.bincount(back, weights=got.col(0), minlength=len(keys)).astype(np.int64)
    keys, n = keys[n > 0], n[n > 0]
    real = n[keys != BEGIN]
    return _words_row(key[0].as_py(), keys, [n], [real.sum(), len(real)])


def _count_pairs(key: tuple, table: pa.Table) -> pa.Table:
    """To every chunk the training count of each of its pairs, times 2; plus 1 in the first chunk that has the pair."""
    got = _Bucket(table)
    _, first, back = np.unique(got.keys, return_index=True, return_inverse=True)
    n = np.bincount(back, weights=got.col(0), minlength=len(first)).astype(np.int64)[back] * 2
    n[first] += 1
    return got.replies(key[0].as_py(), [n])


def _answer(sets: slice):
    """To every chunk the words' columns."""

    def run(key, table, words):
        got, row = _Bucket(table), words.to_pylist()
        if not row:
            return got.replies(key[0].as_py(), [np.zeros(len(got.keys), np.int64)])
        known = unpacked(row[0]["keys"], np.uint64, True)
        at = np.minimum(np.searchsorted(known, got.keys), max(len(known) - 1, 0))
        there = known[at] == got.keys if len(known) else np.zeros(len(got.keys), bool)
        cols = [unpacked(c) for c in row[0]["cols"][sets]]
        return got.replies(key[0].as_py(), [np.where(there, c[at] if len(c) else 0, 0) for c in cols])

    return run


def _own_cells(buckets: int):
    """A chunk's own pairs: slices of their sums by word, and a row (bucket -1) of those with more than one customer."""

    def run(key, table, replies):
        row = table.to_pylist()[0]
        keys, _, _, pairs = Pairs.of(row)
        n = _joined(replies)[0]
        own = np.flatnonzero((n & 1 == 1) & (n > 1))
        c, u, w = n[own] >> 1, pairs.context[own], pairs.word[own]
        total = lambda x, part: np.bincount(x[part], minlength=len(keys)).astype(np.int64)
        cols = [total(x, part) for part in (c == 1, c > 0) for x in (u, w)]
        used = np.flatnonzero(cols[2] + cols[3])
        many = np.flatnonzero(c > 1)
        active = np.unique(np.concatenate([u[many], w[many]]))
        place = [np.searchsorted(active, x[many]).astype(np.int64) for x in (u, w)]
        cells = pa.table(
            {
                "chunk": pa.array([row["chunk"]], pa.int64()),
                "bucket": pa.array([-1], pa.int32()),
                "keys": pa.array([packed(keys[active], True)], pa.binary()),
                "cols": pa.array([[packed(x) for x in (*place, c[many])]], pa.list_(pa.binary())),
                "nums": pa.array([[int((c == 1).sum()), int((c == 2).sum())]], pa.list_(pa.int64())),
            }
        )
        sums = pa.Table.from_batches([_slices(row["chunk"], keys[used], buckets, [x[used] for x in cols])])
        return pa.concat_tables([cells, sums.append_column("nums", pa.array([None] * sums.num_rows, pa.list_(pa.int64())))])

    return run


def _first_seating(key: tuple, words: pa.Table, table: pa.Table) -> pa.Table:
    """Words with sums of single cells and the seating of one table a cell: c, singles as context and as word, then tables, customers and the parent's tables."""
    row, got = words.to_pylist()[0], _Bucket(table)
    keys, c = unpacked(row["keys"], np.uint64, True), unpacked(row["cols"][0])
    at = np.searchsorted(keys, got.keys)
    sums = [np.bincount(at, weights=got.col(k), minlength=len(keys)).astype(np.int64) for k in range(4)]
    customers = sums[3]
    return _words_row(key[0].as_py(), keys, [c, *sums, np.minimum(customers, 1)], [customers.sum(), (customers > 0).sum(), (customers == 1).sum(), (customers == 2).sum()])


def _sweep_cells(model: Model, sweep: int, buckets: int):
    """The seating of a chunk's own cells after that sweep, summed by context and by word."""

    def run(key, cells, replies):
        row = cells.to_pylist()[0]
        keys, (u, w, c) = unpacked(row["keys"], np.uint64, True), map(unpacked, row["cols"])
        if not len(c):
            return pa.Table.from_batches([_slices(row["chunk"], keys[:0], buckets, [])])
        cols = _joined(replies)[3:]
        t = model.seatings(sweep, c, pair_keys(keys[u], keys[w]), [cols[3 * s][u] for s in range(sweep)], [cols[3 * s + 1][w] for s in range(sweep)], [cols[3 * s + 2][w] for s in range(sweep)])[-1]
        sums = [np.bincount(x, weights=t, minlength=len(keys)).astype(np.int64) for x in (u, w)]
        return pa.Table.from_batches([_slices(row["chunk"], keys, buckets, sums)])

    return run


def _sweep_words(model: Model, sweep: int):
    """Words with the columns of one more sweep: the context's tables, the parent's customers, the parent's tables."""

    def run(key, words, table):
        row, got = words.to_pylist()[0], _Bucket(table)
        keys, old = unpacked(row["keys"], np.uint64, True), [unpacked(c) for c in row["cols"]]
        at = np.searchsorted(keys, got.keys)
        tables, customers = (old[1 + k] + np.bincount(at, weights=got.col(k) if len(at) else None, minlength=len(keys)).astype(np.int64) for k in (0, 1))
        own = seat(customers, np.full(len(keys), model.parent_chance(sweep - 1)), model.d0, keys, sweep, stirling_logs(model.d0))
        return _words_row(key[0].as_py(), keys, [*old, tables, customers, own], [customers.sum(), own.sum()])

    return run


def _scored(model: Model, sweeps: range, tokens: int):
    def run(key, table, replies):
        row = table.to_pylist()[0]
        keys, words, sizes, pairs = Pairs.of(row)
        kind = replies.column("kind")
        told, n = _joined(replies.filter(pa.compute.equal(kind, 0))), _joined(replies.filter(pa.compute.equal(kind, 1)))[0] >> 1
        last = sweeps[-1]
        told += [np.zeros(len(keys), np.int64)] * (3 + 3 * (last + 1) - len(told))
        count, context, customers, tables = told[0], told[3::3], told[4::3], told[5::3]
        p = np.zeros(len(n))
        for a in range(0, len(n), BLOCK):
            part = slice(a, a + BLOCK)
            c, u, w = n[part], pairs.context[part], pairs.word[part]
            seated = model.seatings(last, c, pairs.keys[part], [x[u] for x in context], [x[w] for x in customers], [x[w] for x in tables])
            for s in sweeps:
                p[part] += (c - model.d * seated[s] + (STRENGTH + model.d * context[s][u]) * model.parent(s, customers[s][w], tables[s][w])) / (STRENGTH + count[u])
        score = np.log10(p / len(sweeps))[pairs.pair]
        base = np.log10((count + 0.5) / (tokens + 0.5 * (model.v + 1)))[words]
        return pa.table(
            {
                "doc_id": table.column("doc_ids").combine_chunks().flatten(),
                "train": pa.array(unpacked(row["train"]) > 0),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(np.add.reduceat((count[words] > 0).astype(np.int64), pairs.first)),
                "base_score": pa.array(np.add.reduceat(base, pairs.first)),
                "score": pa.array(np.add.reduceat(score, pairs.first)),
            }
        )

    return run


def score(docs: DataFrame, train: str = "crc32(coalesce(CAST(doc_id AS STRING), '')) % 5 != 1", sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every text.

    docs has doc_id and text; other columns are left aside but for those that
    train, an SQL condition, may name: rows for which it is true teach, all
    others, null included, are held out.  A null text is an empty one: its end
    is its one token.  Repeated rows count and are scored each.  Without
    training rows every word has the probability 1 of the one class of unknown
    words.
    """
    parts = docs.select("doc_id", F.coalesce(F.expr(train), F.lit(False)).alias("train"), F.col("text").cast("string").alias("text"))
    spark, name = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    made = "chunk long, doc_ids array<{}>, train binary, sizes binary, keys binary, counts binary, words binary, n_keys long, n_words long".format(name)
    texts = scratch.table(parts.mapInArrow(_chunked, made), "chunks")
    n_keys, n_words = texts.agg(F.sum("n_keys"), F.sum("n_words")).first()
    word_buckets, pair_buckets = (1 + (n or 0) // BUCKET_KEYS for n in (n_keys, n_words))
    lexicon = texts.select("chunk", "keys", "counts")
    ask = lexicon.mapInArrow(_lexicon_slices(word_buckets, True), _SLICE)
    words = scratch.table(ask.groupBy("bucket").applyInArrow(_count_words, _WORDS), "words")
    tokens, vocabulary = (x or 0 for x in words.agg(F.sum(F.expr("nums[0]")), F.sum(F.expr("nums[1]"))).first())

    scratch.release(spark)
    streams = texts.select("chunk", "keys", "words", "sizes", "train")
    ask = streams.mapInArrow(_pair_slices(pair_buckets), _SLICE)
    pairs = scratch.table(ask.groupBy("bucket").applyInArrow(_count_pairs, _SLICE), "pairs")
    scratch.release(spark)
    by_chunk = streams.groupBy("chunk").cogroup(pairs.groupBy("chunk"))
    found = scratch.table(by_chunk.applyInArrow(_own_cells(word_buckets), _SLICE + ", nums array<long>"), "cells")
    scratch.release(spark)
    cells, sums = found.where("bucket < 0"), found.where("bucket >= 0").drop("nums")
    counted, words = words, scratch.table(words.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(_first_seating, _WORDS), "words-0")
    scratch.discard(counted)
    once, twice = (x or 0 for x in cells.agg(F.sum(F.expr("nums[0]")), F.sum(F.expr("nums[1]"))).first())
    totals = [x or 0 for x in words.agg(*[F.sum(F.expr(f"nums[{k}]")) for k in range(4)]).first()]
    model = Model(vocabulary, _discount(once, twice), _discount(*totals[2:]))
    model.customers.append(totals[0])
    model.tables.append(totals[1])

    ask = cells.select("chunk", "keys", F.lit(None).cast("binary").alias("counts")).mapInArrow(_lexicon_slices(word_buckets, False), _SLICE)
    for s in range(1, sweeps + 1):
        told = ask.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(_answer(slice(None)), _SLICE)
        seated = cells.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_sweep_cells(model, s, word_buckets), _SLICE)
        before, words = words, scratch.table(words.groupBy("bucket").cogroup(seated.groupBy("bucket")).applyInArrow(_sweep_words(model, s), _WORDS), f"words-{s}")
        totals = [x or 0 for x in words.agg(F.sum(F.expr("nums[0]")), F.sum(F.expr("nums[1]"))).first()]
        model.customers.append(totals[0])
        model.tables.append(totals[1])
        scratch.discard(before)

    scratch.discard(found)
    scratch.release(spark)
    ask = lexicon.mapInArrow(_lexicon_slices(word_buckets, False), _SLICE)
    told = ask.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(_answer(slice(None)), _SLICE)
    kind = lambda df, k: df.select("chunk", "bucket", "cols", F.lit(k).alias("kind"))
    replies = kind(told, 0).union(kind(pairs, 1))
    rows = texts.select("chunk", "doc_ids", "keys", "words", "sizes", "train").groupBy("chunk").cogroup(replies.groupBy("chunk"))
    made = f"doc_id {name}, train boolean, n_tokens long, n_known long, base_score double, score double"
    out = rows.applyInArrow(_scored(model, range(min(burn_in, sweeps - 1) + 1, sweeps + 1), tokens), made)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity)
