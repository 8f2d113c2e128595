"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt at
random into cells of bounded size; every cell is evolved by several islands,
each a group of its own for Spark, which exchange their elite by a shuffle.  A
solution is a list of bins: crossover injects well-filled bins of one parent
into the other, drops the bins that hold the same pieces twice, and puts the
displaced pieces back by best fit.  An island that reaches the lower bound,
the token sum over the capacity, has proved its solution and rests.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm import scratch
from tallow.llm.bpe import encoder

#: Pieces of a cell, on average; an island's memory and time follow it.
CELL_PIECES = 2048
ISLANDS = 3
EPOCHS = 2
POPULATION = 6
GENERATIONS = 8
#: Bins filled less than this share of the capacity are opened and packed anew across cells.
REPACK_BELOW = 0.9


def _piece_rows(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = encoder(path)
        tail = np.array([end_id], np.int32)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(engine.encode(batch.column(1))):
                ids = np.concatenate([ids, tail]).astype("<u4")
                at, k, n = 0, 0, len(ids)
                step = n % capacity or capacity
                while at < n:
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(step)
                    crc.append(zlib.crc32(ids[at : at + step].tobytes()))
                    at, k, step = at + step, k + 1, capacity
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and end_id, cut only if longer than capacity; the first piece takes the rest."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_piece_rows(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(items: list[int], size: list[int], bins: list[list[int]], capacity: int) -> None:
    """Put items, largest first, each into the fullest bin that takes it, or a new one."""
    free = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=size.__getitem__, reverse=True):
        at = bisect_left(free, (size[i], -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if room - size[i]:
            insort(free, (room - size[i], k))


def exchange(pool: list[int], size: list[int], bins: list[list[int]], capacity: int) -> list[int]:
    """What is left of pool once bins are filled up from it: a bin takes a piece that fills its room, or a piece of the pool in place of a smaller one of its own.

    A bin becomes fuller by each step and the pool's pieces smaller, which
    find places more easily.  Bins are served from the fullest on; of the
    exchanges of a bin the one that leaves the least room is made.
    """
    if not pool:
        return pool
    have = sorted((size[i], i) for i in pool)
    room = [capacity - sum(size[i] for i in b) for b in bins]
    for k in sorted(range(len(bins)), key=room.__getitem__):
        left, b = room[k], bins[k]
        if not left:
            continue
        at = bisect_right(have, (left, len(size))) - 1
        best, give = (left - have[at][0], None) if at >= 0 else (left, None)
        take = at
        for n, i in enumerate(b):
            at = bisect_right(have, (size[i] + left, len(size))) - 1
            if at >= 0 and have[at][0] > size[i] and size[i] + left - have[at][0] < best:
                best, give, take = size[i] + left - have[at][0], n, at
        if best == left:
            continue
        _, j = have.pop(take)
        if give is None:
            b.append(j)
        else:
            insort(have, (size[b[give]], b[give]))
            b[give] = j
        if not have:
            break
    return [i for _, i in have]


def concentrate(bins: list[list[int]], size: list[int], capacity: int) -> None:
    """Exchange pieces between bins until those that can be are full to the last token; what room there is gathers in few bins.

    A bin takes, alone or for one of its own, the piece that leaves it the
    least room, from a bin with no less room: fills grow more unlike with each
    step, so the steps come to an end, and bins with much room can be emptied.
    """
    room = [capacity - sum(size[i] for i in b) for b in bins]
    home = {i: k for k, b in enumerate(bins) if room[k] for i in b}
    of: dict[int, set[int]] = {}
    for i in home:
        of.setdefault(size[i], set()).add(i)
    sizes = sorted(of)
    for k in sorted((k for k, r in enumerate(room) if r), key=room.__getitem__):
        while room[k]:
            best = (0, None, None)
            for n in range(-1, len(bins[k])):
                own = size[bins[k][n]] if n >= 0 else 0
                at = bisect_right(sizes, own + room[k]) - 1
                for x in sizes[max(at - NEAR, 0) : at + 1][::-1]:
                    if x - own <= best[0]:
                        break
                    j = next((j for j in of[x] if home[j] != k and room[home[j]] >= room[k]), None)
                    if j is not None:
                        best = (x - own, n, j)
            gain, n, j = best
            if j is None:
                break
            other = home[j]
            bins[other].remove(j)
            if n >= 0:
                i, bins[k][n] = bins[k][n], j
                bins[other].append(i)
                home[i] = other
            else:
                bins[k].append(j)
            home[j] = k
            room[k] -= gain
            room[other] += gain
        if not room[k]:
            for i in bins[k]:
                if i in home:
                    of[size[i]].discard(i)
    bins[:] = [b for b in bins if b]


#: Sizes next to the wanted one that are looked at.
NEAR = 8


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones; less is better."""
    return len(bins), -sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins)


def _settled(child: list[list[int]], loose: list[int], size: list[int], capacity: int) -> list[list[int]]:
    """child with the displaced pieces put back: by exchanges that fill bins, by best fit, and by exchanges between bins."""
    best_fit(exchange(loose, size, child, capacity), size, child, capacity)
    concentrate(child, size, capacity)
    return child


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """A child: b's well-filled bins in place of the bins of a that they touch; the displaced pieces are put back."""
    full = sorted(b, key=lambda x: -sum(size[i] for i in x))
    few = full[: max(1, len(full) // 2)]
    at = sorted(rng.integers(0, len(few) + 1, 2).tolist())
    taken = few[at[0] : max(at[1], at[0] + 1)]
    own = {i for x in taken for i in x}
    child = [list(x) for x in taken] + [list(x) for x in a if not own.intersection(x)]
    return _settled(child, [i for x in a if own.intersection(x) for i in x if i not in own], size, capacity)


def mutate(bins: list[list[int]], size: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Open the emptiest bin and a third of the others that have room, and put their pieces back."""
    fill = [sum(size[i] for i in b) for b in bins]
    loose_bins = [k for k, f in enumerate(fill) if f < capacity] or [0]
    open_ = {min(loose_bins, key=fill.__getitem__), *rng.choice(loose_bins, len(loose_bins) // 3, replace=False).tolist()}
    child = [list(b) for k, b in enumerate(bins) if k not in open_]
    loose = [i for k in open_ for i in bins[k]]
    rng.shuffle(loose)
    return _settled(child, loose, size, capacity)


def evolve(size: list[int], elites: list[list[list[int]]], capacity: int, seed: int) -> list[list[int]]:
    """The best solution after GENERATIONS from best fit, random orders and the elites given."""
    bound = -(-sum(size) // capacity)
    first: list[list[int]] = []
    best_fit(list(range(len(size))), size, first, capacity)
    concentrate(first, size, capacity)
    group = [*elites, first]
    best = min(group, key=lambda x: fitness(x, size, capacity))
    if len(best) <= bound:
        return best
    rng = np.random.default_rng(seed)
    while len(group) < POPULATION:
        group.append(mutate(mutate(first, size, capacity, rng), size, capacity, rng))
    for _ in range(GENERATIONS):
        group.sort(key=lambda x: fitness(x, size, capacity))
        if len(group[0]) <= bound:
            break
        children = [crossover(group[i], group[j], size, capacity, rng) for i, j in zip(rng.integers(0, 3, POPULATION // 2), rng.integers(0, POPULATION, POPULATION // 2))]
        children = [mutate(c, size, capacity, rng) for c in children]
        group = sorted(group + children, key=lambda x: fitness(x, size, capacity))[:POPULATION]
    return min(group, key=lambda x: fitness(x, size, capacity))


def _island(capacity: int, epoch: int, key: tuple, table: pa.Table) -> pa.Table:
    """One epoch of one island; rows come with the bins of its own elite and of the migrants, -1 at first."""
    uid = table.column("uid").to_numpy()
    length = table.column("length").to_numpy()
    source = table.column("source").to_numpy()
    bin_ = table.column("bin").to_numpy()
    order = np.lexsort((uid, source))
    uid, length, source, bin_ = uid[order], length[order], source[order], bin_[order]
    kinds = np.unique(source)
    n = int((source == kinds[0]).sum())
    size = length[:n].tolist()
    elites = []
    for k in range(len(kinds)):
        own = bin_[k * n : (k + 1) * n]
        if n and own[0] >= 0:
            sol: dict[int, list[int]] = {}
            for i, b in enumerate(own.tolist()):
                sol.setdefault(b, []).append(i)
            elites.append(list(sol.values()))
    cell, island = key[0].as_py(), key[1].as_py()
    best = evolve(size, elites, capacity, hash((cell, island, epoch)) & 0x7FFFFFFF)
    out, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    fill = np.zeros(n, np.int64)
    for k, b in enumerate(best):
        place = 0
        for i in b:
            out[i], at[i] = k, place
            place += size[i]
        fill[b] = place
    bins, unlike = fitness(best, size, capacity)
    col = lambda x, t: pa.array(np.full(n, x), t)
    return pa.Table.from_arrays(
        [col(cell, pa.int64()), col(island, pa.int32()), pa.array(uid[:n]), pa.array(length[:n]), pa.array(out), pa.array(at), pa.array(fill), col(bins, pa.int64()), col(unlike, pa.float64())],
        ["cell", "island", "uid", "length", "bin", "offset", "fill", "bins", "unlike"],
    )


def _epoch(capacity: int, epoch: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _island(capacity, epoch, key, table)

    return run


_SOLUTION = "cell long, island int, uid long, length long, bin long, offset long, fill long, bins long, unlike double"


def _packed(rows: DataFrame, capacity: int) -> DataFrame:
    """(cell, uid, length, bin, offset, fill) of the best island of each cell; rows has uid, length."""
    n = rows.count()
    cells = max(1, -(-n // CELL_PIECES))
    cell = F.pmod(F.xxhash64("uid", F.lit(17)), F.lit(cells)).alias("cell")
    state = rows.select(cell, F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "uid", "length", F.lit(-1).cast("long").alias("bin"), F.lit(0).alias("source"))
    for epoch in range(EPOCHS):
        best = state.groupBy("cell", "island").applyInArrow(_epoch(capacity, epoch), _SOLUTION)
        best = scratch.table(best, "islands")
        own = best.select("cell", "island", "uid", "length", "bin", F.lit(0).alias("source"))
        state = own.union(own.withColumns({"island": F.pmod(F.col("island") + 1, F.lit(ISLANDS)), "source": F.lit(1)}))
    winner = best.groupBy("cell").agg(F.min(F.struct("bins", "unlike", "island"))["island"].alias("island"))
    return best.join(winner.hint("merge"), ["cell", "island"]).select("cell", "uid", "length", "bin", "offset", "fill")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with sequence_id and offset; sequences have no gaps and hold capacity tokens at most.

    docs needs doc_id and text; a null or empty text is the end token alone.
    Repeated rows are packed as often as they occur, equal lengths in any
    order; other columns are ignored; an empty table gives an empty one.
    """
    cut = scratch.table(pieces(docs, path, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    lone = cut.where(F.col("length") == capacity).select("uid", F.lit(0).cast("long").alias("round"), F.col("uid").alias("cell"), F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"))
    first = scratch.table(_packed(cut.where(F.col("length") < capacity).select("uid", "length"), capacity), "packed")
    well = F.col("fill") >= REPACK_BELOW * capacity
    place = ["cell", "bin", "offset"]
    done = first.where(well).select("uid", F.lit(1).cast("long").alias("round"), *place)
    again = _packed(first.where(~well).select("uid", "length"), capacity).select("uid", F.lit(2).cast("long").alias("round"), *place)
    placed = lone.union(done).union(again)
    out = cut.join(placed.hint("merge"), "uid")
    # A sequence's number: the least uid would need a pass; its round, cell and bin name it as well.
    number = F.when(F.col("round") == 0, -1 - F.col("cell")).otherwise((F.col("cell") * 2 + F.col("round") - 1) * (2 * CELL_PIECES * 64) + F.col("bin"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset")
