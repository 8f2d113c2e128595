"""Exact n-gram Jaccard self-join by a token-group matrix.

Sets are the distinct k-word shingles of a text; two texts link when
``100 * |A n B| >= 75 * |A u B|`` (the percentage is a parameter).  The result
is one row per document with the class of documents reachable by links, which
needs no list of all pairs within a group of copies.

Method
------
1. *Classes.* Documents with equal sets share a 64-bit fingerprint and count as
   one.  A second fingerprint, of word hashes at another base, is held against
   it: the two confuse a pair of sets with probability 2^-110 or so, and one
   that disagrees stops the job.
2. *Bounding scan.* A set that links with any other shares at least k of its
   first ``n - ceil(t n) + k`` tokens in hash order with it.  One pass counts,
   for every class, how many of those tokens any other class has as well;
   tasks add up what they know by themselves and send one posting a token, so
   a token of a third of all documents sends one posting a task.  Only classes
   that reach k go on.
3. *Groups.* The survivors' tokens are counted exactly; a class goes on if the
   tokens it shares with somebody reach the threshold by themselves.  Classes
   of equal min-hash form a group, compared at first only with three pivots,
   its least edited members.  Links merge classes into components.
4. *Matrix.* The cells (group, component) are the matrix's columns, their token
   union its rows.  Cells that share a prefix token and pass the size and the
   position bound are compared by pivots again; then every class of the one
   cell queries the other, whose union bounds the overlap with any member.
   Only cells that qualify are opened and their members compared exactly.

No candidate is dropped: each bound is an upper bound of the true overlap, and
pairs within one component need no comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm import scratch
from tallow.llm.components import components
from tallow.llm.textbatch import chunks, fingerprint, shingles

#: A table of at most so many keys of 8 bytes is sent to all executors; a larger one is shuffled.
BROADCAST_KEYS = 4_000_000
#: Postings that a task holds before it hands them on.
BLOCK_POSTINGS = 4_000_000


def _need(n: np.ndarray | int, pct: int):
    """Least overlap with a set of n tokens that any linked set has."""
    return (pct * n + 99) // 100


def _k(n):
    return np.maximum(1, n // 8)


def _class_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, fs, gs = [], [], []
            for _, data, offs in chunks(batch.column(1)):
                for s, other in zip(shingles(data, offs, k), shingles(data, offs, k, base=1)):
                    ns.append(len(s))
                    fs.append(fingerprint(s))
                    gs.append(fingerprint(other))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(fs, pa.int64()), pa.array(gs, pa.int64())],
                ["doc_id", "n_shingles", "fp", "fp2"],
            )

    return run


def document_classes(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, fp, fp2) of every row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _class_rows(k), "doc_id long, n_shingles long, fp long, fp2 long"
    )


def _postings(k: int, pct: int, buckets: int):
    """Rows (bucket, rest of the token's bits, fp); fp 0 stands for several. Negative buckets carry (fp, count) that need no exchange of postings."""

    def block(sets: dict[int, np.ndarray], seq: int) -> Iterator[pa.RecordBatch]:
        fps = np.fromiter(sets.keys(), np.int64, len(sets))
        sizes = np.fromiter(map(len, sets.values()), np.int64, len(sets))
        token = np.concatenate(list(sets.values()))
        owner = np.repeat(np.arange(len(fps)), sizes)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        width = np.diff(np.append(first, len(token)))
        several = np.repeat(width > 1, width)
        credit = np.bincount(owner[several], minlength=len(fps))
        have = np.flatnonzero(credit)
        key = token[first]
        own = np.where(width > 1, 0, fps[owner[first]])
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = [(b, cut[b], cut[b + 1]) for b in range(buckets) if cut[b] < cut[b + 1]]
        ids = [b for b, _, _ in at] + [-1 - seq]
        tok = [low[x:y].tobytes() for _, x, y in at] + [credit[have].astype(np.uint32).tobytes()]
        who = [own[x:y].tobytes() for _, x, y in at] + [fps[have].tobytes()]
        for x in range(0, len(ids), 64):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[x : x + 64], pa.int64()), pa.array(tok[x : x + 64], pa.binary()), pa.array(who[x : x + 64], pa.binary())],
                ["bucket", "tok", "own"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        seq = TaskContext.get().partitionId() << 32  # a rerun must send its credits where the lost run did
        for batch in batches:
            for _, data, offs in chunks(batch.column(0)):
                for s in shingles(data, offs, k):
                    n = len(s)
                    if not n:
                        continue
                    fp = fingerprint(s)
                    if fp not in sets:
                        take = min(n, n - _need(n, pct) + max(1, n // 8) + 1)
                        sets[fp] = s[:take].copy()
                        held += take
                if held >= BLOCK_POSTINGS:
                    yield from block(sets, seq)
                    sets, held, seq = {}, 0, seq + 1
        if sets:
            yield from block(sets, seq)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """(fp, count) of a bucket: postings whose token another class has too."""
    schema = pa.schema([("fp", pa.int64()), ("n", pa.int64())])
    tok = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("tok")])
    own = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("own")])
    if table.column("bucket")[0].as_py() < 0:
        return pa.Table.from_arrays([pa.array(own), pa.array(tok.astype(np.int64))], schema=schema)
    order = np.argsort(tok, kind="stable")
    tok, own = tok[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
    width = np.diff(np.append(first, len(tok)))
    low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
    many = (low != high) | (low == 0)
    pick = np.repeat(many, width) & (own != 0)
    fp = own[pick]  # a row each: their number follows the postings, however many buckets there are
    return pa.Table.from_arrays([pa.array(fp), pa.array(np.ones(len(fp), np.int64))], schema=schema)


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offs in chunks(batch.column(0)):
                sets = [s for s in shingles(data, offs, k) if len(s)]
                if not sets:
                    continue
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([fingerprint(s) for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64))),
                    ],
                    ["fp", "n", "toks"],
                )

    return run


def _survivors(docs: DataFrame, classes: DataFrame, k: int, pct: int) -> DataFrame:
    """(fp, rep) of the classes that the bounding scan leaves."""
    spark = docs.sparkSession
    tokens = classes.agg(F.sum("n")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parts, tokens >> 20)
    posted = docs.select(F.col("text").cast("string")).mapInArrow(_postings(k, pct, buckets), "bucket long, tok binary, own binary")
    counts = posted.groupBy("bucket").applyInArrow(_shared, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("shared"))
    kept = classes.join(counts.hint("merge"), "fp").where(F.col("shared") >= F.greatest(F.lit(1), F.floor(F.col("n") / 8)))
    return scratch.table(kept.select("fp", "rep"), "survivors")


def _sets(docs: DataFrame, some: DataFrame, k: int) -> DataFrame:
    """(fp, n, toks) of the classes in some, from their representatives' texts."""
    reps = some.select(F.col("rep").alias("doc_id"))
    reps = F.broadcast(reps) if reps.count() <= BROADCAST_KEYS else reps.hint("merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(reps, "doc_id", "left_semi").select("text").mapInArrow(_set_rows(k), "fp long, n long, toks array<bigint>")


def _ordered(sets: DataFrame, pct: int) -> DataFrame:
    """(fp, n, s, g, toks): tokens that another class has too, rarest first; classes that these can't link are left out."""
    each = sets.select("fp", "n", F.explode("toks").alias("tok"))
    df = each.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    both = each.join(df.hint("merge"), "tok")
    own = both.groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("t"))
    own = own.withColumn("s", F.size("t").cast("long")).where(100 * F.col("s") >= pct * F.col("n"))
    return own.select("fp", "n", "s", F.col("t.tok").alias("toks")).withColumn("g", F.array_min("toks"))


def _verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Those (a, b) of pairs whose sets link; classes that share all but equal tokens only meet in toks."""
    left = sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    right = sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    full = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    return full.where(100 * both >= pct * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _size_fits(pct: int, low_a: str, high_a: str, low_b: str, high_b: str):
    """Sizes in these ranges can link."""
    return (100 * F.col(high_a) >= pct * F.col(low_b)) & (100 * F.col(high_b) >= pct * F.col(low_a))


def _overlap(pct: int, n):
    """Least overlap of two linked sets with n tokens together, times (100 + pct)."""
    return pct * n


def _members(comp: DataFrame) -> DataFrame:
    """(fp, n, g, component, cell) of every class, written; component may be null, then the class is one by itself."""
    own = F.coalesce("component", "fp")
    return scratch.table(comp.select("fp", "n", "g", own.alias("component"), F.xxhash64("g", own).alias("cell")), "members")


def _merged(member: DataFrame, links: DataFrame) -> DataFrame:
    """member with the components joined that links lead across; the same table if none does."""
    ends = [member.select(F.col("fp").alias(x), F.col("component").alias(f"c{x}")).hint("merge") for x in "ab"]
    # Only components are vertices here: links within them were followed before.
    comp = components(links.join(ends[0], "a").join(ends[1], "b"), "ca", "cb")
    if comp.isEmpty():
        return member
    comp = comp.select(F.col("id").alias("component"), F.col("component").alias("least"))
    return _members(member.join(comp, "component", "left").select("fp", "n", "g", F.coalesce("least", "component").alias("component")))


def _matrix(prefix: DataFrame, member: DataFrame) -> DataFrame:
    """The matrix's prefix part: (tok, cell, component, low, high, rest)."""
    full = prefix.join(member.select("fp", "n", "component", "cell").hint("merge"), "fp")
    return full.groupBy("tok", "cell", "component").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))


def _cell_pairs(matrix: DataFrame, pct: int) -> DataFrame:
    """Distinct (x, y) of cells in different components that share a prefix token and pass the bounds."""
    x, y = (matrix.select("tok", *[F.col(c).alias(f"{c}_{side}") for c in ("cell", "component", "low", "high", "rest")]) for side in "xy")
    near = F.least("rest_x", "rest_y") * (100 + pct) >= _overlap(pct, F.col("low_x") + F.col("low_y"))
    met = x.join(y.hint("merge"), "tok").where((F.col("component_x") < F.col("component_y")) & near & _size_fits(pct, "low_x", "high_x", "low_y", "high_y"))
    return met.select(F.col("cell_x").alias("x"), F.col("cell_y").alias("y")).distinct()


def linked_classes(docs: DataFrame, k: int = 5, pct: int = 75, classes: DataFrame | None = None) -> DataFrame:
    """(fp, component) of the classes that can link; component is the least fingerprint reachable by links.

    Each step is written, and one that leaves nothing ends the search: a plan of
    many joins costs the driver memory by its exchanges and by its repeated
    planning, whatever the rows.  Between the steps the driver collects its
    garbage, with which go the shuffle files of those before.
    """
    if classes is None:
        classes = document_classes(docs, k).where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    some = _survivors(docs, classes, k, pct)
    raw = scratch.table(_sets(docs, some, k), "sets")
    sets = scratch.table(_ordered(raw, pct), "ordered")
    scratch.release(docs.sparkSession)
    take = (F.col("n") - F.ceil(F.col("n") * pct / 100.0) + 1 - (F.col("n") - F.col("s"))).cast("int")
    prefix = sets.select("fp", "s", F.posexplode(F.slice("toks", F.lit(1), F.greatest(take, F.lit(0)))).alias("pos", "tok"))
    prefix = scratch.table(prefix.select("fp", "tok", (F.col("s") - F.col("pos")).alias("rest")), "prefix")

    # Pivots of each group: the member with the fewest tokens of its own, by thirds of the fingerprints.
    score = F.struct((F.col("n") - F.col("s")).alias("own"), F.col("fp").alias("fp"))
    thirds = [F.min(F.when(F.pmod("fp", F.lit(3)) == j, score)).alias(f"p{j}") for j in range(3)]
    pivots = sets.groupBy("g").agg(F.count("*").alias("m"), *thirds).where("m > 1")
    pivots = pivots.select("g", F.explode(F.array_compact(F.array("p0", "p1", "p2"))).alias("p")).select("g", F.col("p.fp").alias("b"))
    # Written first: with an exchange of its own, the join below may split a group of very many members.
    pivots = scratch.table(pivots, "pivots")
    stars = sets.select("g", F.col("fp").alias("a")).join(pivots.hint("merge"), "g").where("a != b").select("a", "b")
    comp = components(scratch.table(_verified(stars, sets, pct), "stars"))
    member = _members(sets.select("fp", "n", "g").join(comp.withColumnRenamed("id", "fp").hint("merge"), "fp", "left"))
    scratch.release(docs.sparkSession)

    # The same between cells that share a prefix token.
    met = scratch.table(_cell_pairs(_matrix(prefix, member), pct), "cells")
    if met.isEmpty():
        return member.select("fp", "component")
    heads = sets.select("fp", score.alias("score")).join(member.select("fp", "cell").hint("merge"), "fp").groupBy("cell").agg(F.min("score")["fp"].alias("fp"))
    heads = scratch.table(heads, "heads")
    pairs = met.join(heads.select(F.col("cell").alias("x"), F.col("fp").alias("a")), "x").join(heads.select(F.col("cell").alias("y"), F.col("fp").alias("b")), "y")
    pairs = scratch.table(pairs.select("a", "b"), "heads-met")
    before, member = member, _merged(member, scratch.table(_verified(pairs, sets, pct), "stars"))
    scratch.release(docs.sparkSession)

    # What is left: each class of the one cell queries the other's union; cells that qualify are opened.
    if member is not before:
        met = scratch.table(_cell_pairs(_matrix(prefix, member), pct), "cells")
    stats = scratch.table(member.groupBy("cell").agg(F.count("*").alias("m"), F.min("n").alias("low"), F.max("n").alias("high")), "sizes")
    x, y = (stats.select(F.col("cell").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("m", "low", "high")]) for s in "xy")
    small = F.col("m_x") <= F.col("m_y")
    other = [F.when(small, F.col(f"{c}_y")).otherwise(F.col(f"{c}_x")).alias(c) for c in ("m", "low", "high")]
    sides = met.join(x, "x").join(y, "y").select(F.when(small, F.col("x")).otherwise(F.col("y")).alias("q"), F.when(small, F.col("y")).otherwise(F.col("x")).alias("cell"), *other)
    query = sides.join(member.select(F.col("cell").alias("q"), F.col("fp").alias("a"), F.col("n").alias("na")), "q")
    query = query.where((100 * F.col("high") >= pct * F.col("na")) & (100 * F.col("na") >= pct * F.col("low"))).select("cell", "a", "na", "low", "m")
    query = scratch.table(query, "queries")
    if query.isEmpty():
        return member.select("fp", "component")
    many = query.where("m > 1")
    union = sets.select("fp", F.explode("toks").alias("tok")).join(member.join(many.select("cell").distinct(), "cell", "left_semi").select("fp", "cell"), "fp")
    union = union.select("cell", "tok").distinct()
    asked = many.join(sets.select(F.col("fp").alias("a"), "toks").hint("merge"), "a").select("cell", "a", "na", "low", F.explode("toks").alias("tok"))
    bound = asked.join(union.hint("merge"), ["cell", "tok"]).groupBy("cell", "a", "na", "low").agg(F.count("*").alias("o"))
    bound = bound.where(F.col("o") * (100 + pct) >= _overlap(pct, F.col("na") + F.col("low"))).select("cell", "a", "na")
    opened = scratch.table(query.where("m = 1").select("cell", "a", "na").union(bound), "opened")
    fits = (100 * F.col("nb") >= pct * F.col("na")) & (100 * F.col("na") >= pct * F.col("nb"))
    pairs = opened.join(member.select("cell", F.col("fp").alias("b"), F.col("n").alias("nb")).hint("merge"), "cell").where(fits).select("a", "b").distinct()
    pairs = scratch.table(pairs, "opened-pairs")
    return _merged(member, scratch.table(_verified(pairs, sets, pct), "links")).select("fp", "component")


def jaccard_components(docs: DataFrame, k: int = 5, pct: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text, ...).

    component_id is the least doc_id reachable by links.  A null or empty text
    has no shingles and links with nothing; repeated rows and copies share a
    component; a null doc_id keeps its row and never names a component unless
    no other document is reachable.  Other columns are ignored, an empty table
    gives an empty result.  docs is read several times and tasks may be rerun:
    a partition must give the same rows in the same order each time, as files do.
    """
    each = scratch.table(document_classes(docs, k), "classes")
    classes = each.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.min("fp2").alias("lo"), F.max("fp2").alias("hi"))
    classes = scratch.table(classes, "class")
    if classes.where("lo != hi").limit(1).count():
        raise RuntimeError("two different sets have one fingerprint; choose another seed in textbatch")
    comp = linked_classes(docs, k, pct, classes)
    # Written: a component of very many classes may then be split, and what is small be sent to all.
    named = scratch.table(classes.select("fp", "rep").join(comp.hint("merge"), "fp"), "named")
    least = scratch.table(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    linked = named.join(least, "component").select("fp", "component_id")
    named = linked.union(classes.join(named, "fp", "left_anti").select("fp", F.col("rep").alias("component_id")))
    out = each.join(named.hint("merge"), "fp", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))
