"""Feature pruning: fitted on training rows, applied anywhere."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallow.functions import scratch

KEEP = ("Open", "High", "Low", "Close", "Volume", "Ticker", "Datetime", "Date")


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, constant, null_share) from one aggregation over all columns."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), (F.coalesce(F.min(x) == F.max(x), F.lit(True))).alias("constant"), F.avg(x.isNull().cast("double")).alias("null_share")).alias(c))
    row = df.agg(F.array(*aggs).alias("s"))
    return row.select(F.explode("s").alias("s")).select("s.*")


def _ranked(df: DataFrame, columns: list[str], rank: Column) -> DataFrame:
    """__id and a column 0, 1, ... for each of columns: rank of before (rows of less value) and n (rows of the value); null where the value is.

    All columns are ranked in one pass over their distinct values.  Rows without any value go.
    """
    rows = scratch.table(df.select(F.monotonically_increasing_id().alias("__id"), *[F.col(c).cast("double").alias(c) for c in columns]), "values")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(c).alias("v")) for k, c in enumerate(columns)]))
    long = rows.select("__id", pairs.alias("x")).select("__id", "x.c", "x.v").where("v IS NOT NULL")
    ranks = scratch.table(_running(long.groupBy("c", "v").agg(F.count("*").alias("n"))), "ranks")
    ranked = long.join(ranks.select("c", "v", rank.alias("r")).hint("merge"), ["c", "v"])
    return ranked.groupBy("__id").pivot("c", list(range(len(columns)))).agg(F.first("r"))


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns replaced by average ranks; nulls stay null, rows without any value go."""
    wide = _ranked(df, columns, F.col("before") + (F.col("n") + 1) / 2)
    return wide.select(*[F.col(str(k)).alias(c) for k, c in enumerate(columns)])


def _running(counts: DataFrame) -> DataFrame:
    """counts (c, v, n) with before: rows of c with smaller values, by prefix sums over range partitions."""
    n = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = scratch.table(counts.repartitionByRange(n, "c", "v").withColumn("__p", F.spark_partition_id()), "ranges")  # a partition's number is only true of this one run
    own = Window.partitionBy("c", "__p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("c", "__p").agg(F.sum("n").alias("t"))  # a row per column and partition
    before = Window.partitionBy("c").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.table(totals.select("c", "__p", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("o")), "offsets")
    inner = parts.withColumn("__i", F.coalesce(F.sum("n").over(own), F.lit(0)))
    return inner.join(offsets, ["c", "__p"]).withColumn("before", F.col("__i") + F.col("o")).drop("__p", "__i", "o")


def dominance(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i w_j over the pairs with u_i < u_j and v_i < v_j, by merging halves."""
    if not len(u):
        return 0.0
    rank = np.unique(v, return_inverse=True)[1]
    order = np.lexsort((-rank, u))  # of equal u the greater v first, so that they never count
    r, w, at, total, s = rank[order].astype(np.int64), w[order].astype(float), np.arange(len(order)), 0.0, 1
    m = int(r.max(initial=0)) + 1
    while s < len(r):
        pair, left = at // (2 * s), at // s % 2 == 0
        key = pair * m + r
        low = np.argsort(key[left], kind="stable")
        keys, sums = key[left][low], np.concatenate([[0.0], np.cumsum(w[left][low])])
        below = sums[np.searchsorted(keys, key[~left])] - sums[np.searchsorted(keys, pair[~left] * m)]
        total += float((w[~left] * below).sum())
        s *= 2
    return total


#: Rows of a range of values at least, but for a column's last; a value of so many rows is a range of its own.
RANGE_ROWS = 1 << 15
#: Ranges of a column at most, about.
RANGES = 1024

_SUMS = ("c", "n0", "tx", "ty", "txy")


def _pairs_of(counts: np.ndarray) -> int:
    return int((counts * (counts - 1) // 2).sum())


def _equal(*keys: np.ndarray) -> int:
    """Pairs of rows that are equal in all keys."""
    return _pairs_of(np.unique(np.column_stack(keys), axis=0, return_counts=True)[1]) if len(keys[0]) else 0


def _codes(table: pa.Table, names: list[str], cap: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """By column: ranks, range codes (odd: one frequent value) and which rows have a value."""
    there = [table.column(c).is_valid().to_numpy(zero_copy_only=False) for c in names]
    held = [table.column(c).fill_null(0).to_numpy() for c in names]
    return [h >> 1 for h in held], [2 * ((h >> 1) // cap) + (h & 1) for h in held], there


def _cells(p: int, cap: int):
    """Rows of a batch by pair of columns and pair of ranges."""

    def run(batches):
        for batch in batches:
            _, code, there = _codes(pa.Table.from_batches([batch]), [str(k) for k in range(p)], cap)
            for i in range(p):
                out = []
                for j in range(i + 1, p):
                    both = there[i] & there[j]
                    cells, n = np.unique(np.column_stack([code[i][both], code[j][both]]), axis=0, return_counts=True)
                    out.append((j, cells, n))
                if out:
                    size = [len(n) for _, _, n in out]
                    ga, gb = (np.concatenate([c[:, k] for _, c, _ in out]) for k in (0, 1))
                    js = np.repeat([j for j, _, _ in out], size)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(js), i, np.int64), js.astype(np.int64), ga, gb, np.concatenate([n for _, _, n in out]))], ["i", "j", "ga", "gb", "n"])

    return run


def _of_cells(key: tuple, table: pa.Table) -> pa.Table:
    """One pair's sums over its ranges: concordant pairs in different ranges of both, all pairs, ties of frequent values."""
    ga, gb, n = (table.column(c).to_numpy() for c in ("ga", "gb", "n"))
    by = lambda g: np.bincount(np.unique(g[g % 2 == 1], return_inverse=True)[1], weights=n[g % 2 == 1]).astype(np.int64) if (g % 2 == 1).any() else np.zeros(0, np.int64)
    heavy = n[(ga % 2 == 1) & (gb % 2 == 1)]
    total = int(n.sum())
    return _sums_row(key[0].as_py(), key[1].as_py(), dominance(ga, gb, n), total * (total - 1) // 2, _pairs_of(by(ga)), _pairs_of(by(gb)), _pairs_of(heavy))


def _sums_row(i: int, j: int, *sums: float) -> pa.Table:
    return pa.table({"i": pa.array([i], pa.int64()), "j": pa.array([j], pa.int64())} | {k: pa.array([float(x)]) for k, x in zip(_SUMS, sums)})


def _of_range(p: int, cap: int):
    """One range of column k with all others: its part of the sums of every pair that k is in."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        k = key[0].as_py()
        rank, code, there = _codes(table, [str(x) for x in range(p)], cap)
        out = []
        for o in range(p):
            if o == k:
                continue
            own, r, g = rank[k][there[o]], rank[o][there[o]], code[o][there[o]]
            one = np.ones(len(own))
            if k < o:  # k is the pair's first: pairs in this range of it
                out.append(_sums_row(k, o, dominance(own, r, one), 0, _equal(own), 0, _equal(own, r)))
            else:  # the second: pairs in this range of it and different ranges of the first; ties with frequent values of the first
                odd = g % 2 == 1
                out.append(_sums_row(o, k, dominance(g, own, one), 0, 0, _equal(own), _equal(own[odd], g[odd])))
        return pa.concat_tables(out)

    return run


def _kendall(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr): tau-b of all pairs, over the rows where both are present, in one set of jobs; null where either is constant.

    Values are coded by rank once, ranks cut into ranges.  Concordant pairs of
    rows stand in different ranges of both columns (counts of pairs of
    ranges), in one range of the first, or in one range of the second and
    different ones of the first.  The rows of a range are the same for all
    pairs that its column is in.  A value too frequent for a range is a range
    of its own that need not be looked into: rows equal in a column are never
    concordant.
    """
    p = len(columns)
    n = df.count()
    cap = max(RANGE_ROWS, n // RANGES)
    wide = scratch.table(_ranked(df, columns, F.col("before") * 2 + (F.col("n") >= cap).cast("long")).drop("__id"), "kendall-ranks")
    sums = "i long, j long, " + ", ".join(f"{c} double" for c in _SUMS)
    cells = wide.mapInArrow(_cells(p, cap), "i long, j long, ga long, gb long, n long").groupBy("i", "j", "ga", "gb").agg(F.sum("n").alias("n"))
    found = cells.groupBy("i", "j").applyInArrow(_of_cells, sums)
    held = F.element_at(F.array(*[F.col(str(k)) for k in range(p)]), F.col("k") + 1)
    ranges = wide.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))).withColumn("__e", held).where("__e IS NOT NULL AND __e % 2 = 0")
    ranges = ranges.withColumn("g", F.floor(F.col("__e") / (2 * cap))).drop("__e")
    found = found.union(ranges.groupBy("k", "g").applyInArrow(_of_range(p, cap), sums))
    total = found.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    scale = (F.col("n0") - F.col("tx")) * (F.col("n0") - F.col("ty"))
    corr = F.when(scale > 0, (2 * F.col("c") - (F.col("n0") - F.col("tx") - F.col("ty") + F.col("txy"))) / F.sqrt(scale))
    named = F.array(*map(F.lit, columns))
    every = df.sparkSession.createDataFrame([(i, j) for i in range(p) for j in range(i + 1, p)], "i long, j long")
    out = every.join(total.hint("merge"), ["i", "j"], "left")
    at = lambda c: F.get(named, F.col(c).cast("int"))
    return out.select(at("i").alias("a"), at("j").alias("b"), corr.alias("corr"))


def kendall(df: DataFrame, a: str, b: str) -> float | None:
    """Tau-b of two columns."""
    return _kendall(df, [a, b]).first()["corr"]


def _gram(columns: list[str]):
    """Partial sums of one partition: for each pair the count, sums, squares and products where both are present."""

    def run(batches):
        p = len(columns)
        m = np.zeros((4, p, p))
        for pdf in batches:
            x = pdf.to_numpy(float)
            ok = ~np.isnan(x)
            x = np.where(ok, x, 0.0)
            w = ok.astype(float)
            m[0] += w.T @ w
            m[1] += x.T @ w
            m[2] += (x * x).T @ w
            m[3] += x.T @ x
        yield pd.DataFrame({"cell": np.arange(p * p), "n": m[0].ravel(), "sx": m[1].ravel(), "sxx": m[2].ravel(), "sxy": m[3].ravel()})

    return run


def correlations(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, corr) for a before b; pairs are those rows where both are present. A constant side gives null.

    pearson centres by training means first, so that the sums lose little; one
    row of p * p sums per partition is all that is exchanged.
    """
    if method == "kendall":
        return _kendall(df.select(*columns), columns)
    if method == "spearman":
        return correlations(average_ranks(df.select(*columns), columns), columns)
    if method != "pearson":
        raise ValueError(f"unknown correlation {method!r}: pearson, spearman or kendall")
    means = df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(columns)])
    centred = df.crossJoin(F.broadcast(means)).select(*[(F.col(c).cast("double") - F.col(f"m{i}")).alias(c) for i, c in enumerate(columns)])
    p = len(columns)
    sums = centred.mapInPandas(_gram(columns), "cell long, n double, sx double, sxx double, sxy double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sxy")])
    sums = sums.select(F.floor(F.col("cell") / p).cast("int").alias("i"), (F.col("cell") % p).cast("int").alias("j"), "n", "sx", "sxx", "sxy")
    back = sums.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))
    full = sums.where("i < j").join(back.hint("merge"), ["i", "j"])
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.when(F.col("n") > 0, F.col("n"))
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.when(F.col("n") > 0, F.col("n"))
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.when(F.col("n") > 0, F.col("n"))
    live = (vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy"))
    corr = F.when(live, F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))
    named = F.array(*map(F.lit, columns))
    return full.select(F.get(named, F.col("i")).alias("a"), F.get(named, F.col("j")).alias("b"), corr.alias("corr"))


@dataclass
class Pruner:
    """Decisions (column, reason, detail) and the columns kept."""

    null_share: float = 0.5
    correlation: float = 0.95
    method: str = "pearson"
    decisions: list[tuple[str, str, str]] | None = None

    def fit(self, train: DataFrame, columns: list[str]) -> "Pruner":
        """Constant columns, columns of too many gaps, and the second of any pair correlated too much; prices are never dropped."""
        some = [c for c in columns if c not in KEEP]
        out: list[tuple[str, str, str]] = []
        for r in column_statistics(train, some).collect() if some else []:  # a row per column
            if r["constant"]:
                out.append((r["column"], "constant", ""))
            elif r["null_share"] > self.null_share:
                out.append((r["column"], "nulls", f"{r['null_share']:.6f}"))
        gone = {d[0] for d in out}
        rest = [c for c in some if c not in gone]
        if len(rest) > 1:
            pairs = correlations(train, rest, self.method).where(F.abs("corr") > self.correlation).collect()  # of p columns
            place = {c: k for k, c in enumerate(rest)}
            for r in sorted(pairs, key=lambda r: (place[r["b"]], place[r["a"]])):
                if r["b"] not in gone:
                    gone.add(r["b"])
                    out.append((r["b"], "correlated", f"{r['a']} {r['corr']:.6f}"))
        self.decisions = out
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        gone = {d[0] for d in self.decisions or []}
        return df.select(*[c for c in df.columns if c not in gone])

    def summary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.decisions or [], "column string, reason string, detail string")

    def to_json(self) -> str:
        return json.dumps({"null_share": self.null_share, "correlation": self.correlation, "method": self.method, "decisions": self.decisions})

    @classmethod
    def from_json(cls, text: str) -> "Pruner":
        d = json.loads(text)
        return cls(d["null_share"], d["correlation"], d["method"], [tuple(x) for x in d["decisions"]])

