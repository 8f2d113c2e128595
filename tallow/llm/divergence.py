"""Divergence between the sources of a language, priced on hash-consed segment trees.

Every (lang, source) group has a segment tree over the term ids of its
language; a leaf holds the group's count of a term.  Subtrees with equal counts
are one node, whichever group or place they stand in.  Two trees are priced by
walking both from the roots at once: a pair of nodes met again is not walked
again but counted, so equal node pairs are priced once.

Term ids are dealt to buckets of bounded size and a bucket's trees are built in
one task, for one pair of blocks of sources; the nodes above the buckets are
plain sums, which Spark adds.  No task holds a language or a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallow.llm import scratch
from tallow.llm.textbatch import LOWER, chunks

#: Terms of a bucket and sources of a block, about; a task holds the counts of one bucket for two blocks.
BUCKET_TERMS = 3500
BLOCK_SOURCES = 32
#: Parts into which the rows of a language or a group are split where they meet its totals.
SALT = 32
#: Bytes of text whose terms are counted at once.
CHUNK = 8 << 20
#: A share of 1 in the integers that shares are kept in.
UNIT = 1_000_000_000

#: Letters after lower-casing: a-z and all that is not ASCII.
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True


def terms_of(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a chunk of texts, and the text that each stands in."""
    low = LOWER[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = LETTER[low]
    here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
    edge = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(low))]
    before[edge] = False
    after[edge - 1] = False
    start, end = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(low[here].tobytes())])
    return terms, np.searchsorted(offs, start, "right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to rows (lang, source, term, n, df), those of a chunk put together."""
    for batch in batches:
        lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
        wide = max(1, len(source.dictionary))
        group = lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy()
        for at, data, offs in chunks(batch.column(2), CHUNK):
            terms, text = terms_of(data, offs)
            if not len(terms):
                continue
            terms = terms.dictionary_encode()
            many = len(terms.dictionary)
            each, times = np.unique(text * many + terms.indices.to_numpy(), return_counts=True)
            keys, back = np.unique(group[at + each // many] * many + each % many, return_inverse=True)
            n = np.bincount(back, weights=times, minlength=len(keys)).astype(np.int64)
            groups, words = keys // many, pa.array(keys % many)
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(groups // wide)).cast(pa.string()),
                    source.dictionary.take(pa.array(groups % wide)).cast(pa.string()),
                    terms.dictionary.take(words).cast(pa.large_string()).cast(pa.string()),
                    pa.array(n),
                    pa.array(np.bincount(back, minlength=len(keys)).astype(np.int64)),
                ],
                ["lang", "source", "term", "n", "df"],
            )


def shares(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exactly; 1 where there are no terms."""
    top, below = count + 2, np.maximum(total + 2 * terms, 1)
    if len(top) and int(top.max()) > (1 << 62) // UNIT:
        return np.array([1 + UNIT * int(a) // int(b) for a, b in zip(top, below)], np.int64)
    return 1 + UNIT * top // below


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most UNIT + 1, so that squares fit."""
    return (p - q) * (p - q) // (p + q)


class Forest:
    """Segment trees of several groups over the same leaves, equal subtrees being one node.

    Of level k, left[k] and right[k] hold a node's children by node; value
    holds the leaves' counts, -1 for a place without a term.  Nodes are told
    apart by their children themselves, not by a hash of them.
    """

    def __init__(self, counts: np.ndarray):
        self.value, ids = np.unique(counts, return_inverse=True)
        ids = ids.reshape(counts.shape)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        while ids.shape[1] > 1:
            below = int(ids.max()) + 1 if ids.size else 1
            keys, back = np.unique(ids[:, 0::2] * below + ids[:, 1::2], return_inverse=True)
            ids = back.reshape(len(ids), -1)
            self.left.append(keys // below)
            self.right.append(keys % below)
        self.root = ids[:, 0]

    def nodes(self) -> int:
        return len(self.value) + sum(map(len, self.left))

    def leaf_pairs(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """For pairs of groups: (pair, count in the first, in the second, leaves with these counts), and node pairs visited."""
        pair, a, b = np.arange(len(first)), self.root[first], self.root[second]
        times, visited = np.ones(len(first), np.int64), len(first)
        for left, right in zip(reversed(self.left), reversed(self.right)):
            pair, times = np.concatenate([pair, pair]), np.concatenate([times, times])
            a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            wide = int(max(a.max(), b.max())) + 1 if len(a) else 1
            keys, back = np.unique((pair * wide + a) * wide + b, return_inverse=True)
            times = np.bincount(back, weights=times, minlength=len(keys)).astype(np.int64)
            pair, a, b = keys // (wide * wide), keys // wide % wide, keys % wide
            visited += len(keys)
        return pair, self.value[a], self.value[b], times, visited


def _priced(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """One bucket's part of the distances between the groups of two blocks."""
    lang, _, block, other = (k.as_py() for k in key)
    groups = np.argsort(right.column("gid").to_numpy())
    get = lambda c: right.column(c).to_numpy()[groups]
    gid, mine, total, terms, size = get("gid"), get("block"), get("total"), get("v"), int(get("size")[0])
    ids, place = np.unique(left.column("term_id").to_numpy(), return_inverse=True)
    n, slot = left.column("n").to_numpy(), np.searchsorted(gid, left.column("gid").to_numpy())
    order = np.argsort(-np.bincount(place, weights=n, minlength=len(ids)), kind="stable")  # rare terms side by side, so that empty subtrees are wide
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    counts = np.full((len(gid), 1 << max(0, size - 1).bit_length()), -1, np.int64)
    counts[:, :size] = 0
    counts[slot, rank[place]] = n
    one, two = np.nonzero((mine[:, None] == block) & (mine[None, :] == other))
    if block == other:
        one, two = one[one < two], two[one < two]
    value = np.zeros(len(one), np.int64)
    pair, a, b, times, _ = Forest(counts).leaf_pairs(one, two)
    there = a >= 0
    pair, a, b, times = pair[there], a[there], b[there], times[there]
    p, q = shares(a, total[one[pair]], terms[one[pair]]), shares(b, total[two[pair]], terms[two[pair]])
    np.add.at(value, pair, distances(p, q) * times)
    names = right.column("source").take(pa.array(groups))
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": names.take(pa.array(one)), "item": names.take(pa.array(two)), "value": value})


def _salted(left: DataFrame, by: str, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined with right's one row for each of its keys, a frequent key's rows split by a hash of column by."""
    many = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(many.hint("merge"), [*keys, "__salt"]).drop("__salt")


def _share(n: str, total: str) -> Column:
    """shares() in SQL."""
    return F.expr(f"1 + CAST((CAST({n} AS DECIMAL(20, 0)) + 2) * {UNIT} AS DECIMAL(38, 0)) div CAST(CAST({total} AS DECIMAL(20, 0)) + 2 * v AS DECIMAL(38, 0))")


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and by which terms.

    docs has text, lang and source; null in any of them is ''.  Other columns
    are left aside, each row counts as a document.  A language keeps the terms
    of at least min_docs of its documents.  Part pair has each other source of
    the language (0 without kept terms), part term the top terms that a group
    uses more than its language.  Ties rank by the item's UTF-8 bytes.  Without
    rows the result is empty.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    found = docs.mapInArrow(_counted, "lang string, source string, term string, n long, df long")
    counts = scratch.table(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("lang_n")).where(F.col("df") >= min_docs)
    kept = scratch.table(kept.drop("df").withColumn("term_id", F.monotonically_increasing_id()), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sizes = scratch.table(sizes.withColumn("buckets", 1 + F.floor(F.col("v") / BUCKET_TERMS)), "sizes")
    bucket = F.expr("pmod(xxhash64(term_id), buckets)").alias("bucket")
    kept = _salted(kept, "term_id", sizes, ["lang"]).select("*", bucket)
    kept = scratch.table(kept, "terms")
    used = scratch.table(counts.drop("df").join(kept.hint("merge"), ["lang", "term"]), "used")

    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("__one")).drop("__one")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    blocks = groups.groupBy("lang").agg(F.floor((F.count("*") - 1) / BLOCK_SOURCES + 1).alias("blocks"))
    groups = groups.join(totals.hint("merge"), ["lang", "source"], "left")
    groups = groups.join(sizes.drop("lang_total").hint("merge"), "lang", "left").join(blocks.hint("merge"), "lang")
    groups = groups.fillna({"total": 0, "v": 0, "buckets": 1}).withColumns({"block": F.expr("pmod(xxhash64(source), blocks)"), "gid": F.monotonically_increasing_id()})
    groups = scratch.table(groups, "groups")
    used = _salted(used.drop("v", "buckets"), "term_id", groups.select("lang", "source", "total", "v", "block", "blocks", "gid"), ["lang", "source"])
    used = scratch.table(used, "shares")

    partner = F.explode(F.expr("sequence(0L, blocks - 1)"))
    ends = lambda df: df.withColumn("__p", partner).withColumns({"b1": F.least("block", "__p"), "b2": F.greatest("block", "__p")})
    left = ends(used.select("lang", "bucket", "block", "blocks", "gid", "term_id", "n")).select("lang", "bucket", "b1", "b2", "gid", "term_id", "n")
    held = scratch.table(kept.groupBy("lang", "bucket").agg(F.count("*").alias("size")), "buckets")
    right = groups.withColumn("bucket", F.explode(F.expr("sequence(0L, buckets - 1)")))
    right = ends(right.join(held.hint("merge"), ["lang", "bucket"], "left").fillna({"size": 0})).select("lang", "bucket", "b1", "b2", "gid", "source", "block", "total", "v", "size")
    keys = ["lang", "bucket", "b1", "b2"]
    priced = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_priced, "lang string, source string, item string, value long")
    pairs = scratch.table(priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
    pairs = pairs.union(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    over = used.withColumns({"p": _share("n", "total"), "q": _share("lang_n", "lang_total")}).where("p > q")
    over = over.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    series = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(series).alias("rank"))
    return ranked(pairs, "pair").union(ranked(over, "term").where(F.col("rank") <= top))
