"""Augmentations that need more than a row: spectra, rotations and neighbours.

Spectra are sums over blocks of a series, rotations work on a small matrix; neighbours are found in blocks along a random projection: a row's own
block bounds the distance, and every block within that bound is searched too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallow.functions import scratch
from tallow.functions.quantiles import quantiles
from tallow.functions.stretches import numbered
from tallow.operators.augment import uniform
from tallow.operators.models import pca_features

#: Least rows of one block, and less than twice as many at most, unless the series is shorter.
BLOCK = 64


def band_bins(n: int, band: str, share: float) -> tuple[int, int]:
    """First and last + 1 of the bins of a series of n rows that a band takes."""
    bins = n // 2 + 1
    k = max(1, int(bins * share))
    first, last = {"low": (1, 1 + k), "mid": (bins // 2 - k // 2, bins // 2 - k // 2 + k), "high": (bins - k, bins)}[band]
    return first, min(last, bins)


#: Rows of a block of a series, whose part of a bin's sums one task adds up, and bins of a slice of the band.
SPECTRUM_ROWS = 4096
SPECTRUM_BINS = 16384


def _spectrum(columns: list[str], band: str, share: float):
    """One block's part of the sums of x cos and x sin over time for every bin of the band."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        n, t = table.column("__n")[0].as_py(), table.column("__t").to_numpy()
        first, last = band_bins(n, band, share)
        x = np.column_stack([table.column(c).fill_null(0.0).to_numpy() for c in columns])
        re, im = np.zeros((last - first, len(columns))), np.zeros((last - first, len(columns)))
        for at in range(first, last, 256):
            k = np.arange(at, min(at + 256, last))
            turn = 2 * np.pi / n * ((k[:, None] * t[None, :]) % n)  # exact in whole numbers before the angle is taken
            re[k - first], im[k - first] = np.cos(turn) @ x, np.sin(turn) @ x
        rows = last - first
        return pa.table({"__s": pa.concat_arrays([table.column("__s").slice(0, 1).combine_chunks()] * rows) if rows else table.column("__s").slice(0, 0), "k": np.arange(first, last), "re": pa.array(re.tolist(), pa.list_(pa.float64())), "im": pa.array(im.tolist(), pa.list_(pa.float64()))})

    return run


def _waves(columns: list[str]):
    """What a slice of the band's bins adds to the rows of a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, t = left.column("__n")[0].as_py(), left.column("__t").to_numpy()
        k = right.column("k").to_numpy()
        re, im = (np.array(right.column(c).to_pylist()).reshape(len(k), len(columns)) for c in ("re", "im"))
        twice = np.where((k == 0) | (2 * k == n), 1.0, 2.0)[:, None] / n
        wave = np.zeros((len(t), len(columns)))
        for at in range(0, len(k), 256):
            p = slice(at, at + 256)
            turn = 2 * np.pi / n * ((t[:, None] * k[None, p]) % n)
            wave += np.cos(turn) @ (re[p] * twice[p]) + np.sin(turn) @ (im[p] * twice[p])
        return pa.table({"__s": left.column("__s"), "__t": left.column("__t")} | {f"__w{j}": wave[:, j] for j in range(len(columns))})

    return run


def frequency_mask(df: DataFrame, columns: list[str], band: str = "high", share: float = 0.2) -> DataFrame:
    """Each feature without the waves of the low, mid or high share of its spectrum; gaps count as 0.

    A distributed transform of the band alone: blocks of rows add up their
    part of each bin's two sums, and every block then takes off the waves of
    every slice of bins.  No task holds a series or its band; the work is rows
    times bins.
    """
    totals = df.groupBy("Ticker").agg(F.count("*").alias("__n"))
    rows = numbered(df.withColumn("Datetime", F.timestamp_micros(F.col("idx"))) if "Datetime" not in df.columns else df.withColumns({"__time": F.col("Datetime"), "Datetime": F.timestamp_micros(F.col("idx"))}), SPECTRUM_ROWS * 16)
    rows = rows.join(scratch.table(totals, "spectra").withColumnRenamed("Ticker", "__ticker"), F.col("Ticker").eqNullSafe(F.col("__ticker"))).drop("__ticker")
    rows = rows.withColumns({"__t": F.col("__row") - 1, "__b": F.floor((F.col("__row") - 1) / SPECTRUM_ROWS), "__s": F.coalesce(F.concat(F.lit("v"), "Ticker"), F.lit("n"))})
    narrow = rows.select("__s", "__b", "__n", "__t", *[F.col(c).cast("double").alias(c) for c in columns])
    sums = narrow.groupBy("__s", "__b").applyInArrow(_spectrum(columns, band, share), "__s string, k long, re array<double>, im array<double>")
    each = lambda c: F.array(*[F.sum(F.get(c, F.lit(j))) for j in range(len(columns))]).alias(c)
    bins = scratch.table(sums.groupBy("__s", "k").agg(each("re"), each("im")), "bins")
    bins = bins.withColumn("__kb", F.floor(F.col("k") / SPECTRUM_BINS))
    slices = scratch.table(bins.select("__s", "__kb").distinct(), "slices")
    blocks = scratch.table(narrow.select("__s", "__b").distinct(), "blocks")
    keys = ["__s", "__b", "__kb"]
    told = blocks.join(bins.hint("merge"), "__s").groupBy(*keys)
    asked = narrow.join(slices.hint("merge"), "__s").groupBy(*keys)
    names = [f"__w{j}" for j in range(len(columns))]
    waves = asked.cogroup(told).applyInArrow(_waves(columns), "__s string, __t long, " + ", ".join(f"{w} double" for w in names))
    waves = waves.groupBy("__s", "__t").agg(*[F.sum(w).alias(w) for w in names])
    if "__time" in rows.columns:
        rows = rows.drop("Datetime").withColumnRenamed("__time", "Datetime")
    new = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.coalesce(F.col(f"__w{j}"), F.lit(0.0)) for j, c in enumerate(columns)}
    return rows.join(waves.hint("merge"), ["__s", "__t"], "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def feature_rotation(df: DataFrame, columns: list[str], angle: float = 0.1, seed: int = 42) -> DataFrame:
    """Rows turned a little in the plane of every two neighbouring principal components and put back; under three features nothing changes."""
    if len(columns) < 3:
        return df
    pcs, _ = pca_features(df, columns, len(columns))
    names = [f"PCA_{j + 1}" for j in range(len(columns))]
    # Loadings from the sums of products of components and features: p * p numbers.
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    sums = pcs.agg(*[F.sum(F.col(a) * (F.col(c) - float(means[c] or 0.0))).alias(f"{a}_{c}") for a in names for c in columns], *[F.sum(F.col(a) * F.col(a)).alias(a) for a in names]).first()
    load = np.array([[sums[f"{a}_{c}"] / (sums[a] or 1.0) for c in columns] for a in names])
    rng = np.random.default_rng(seed)
    turn = np.eye(len(names))
    for j in range(len(names) - 1):
        t = rng.uniform(-angle, angle)
        g = np.eye(len(names))
        g[[j, j, j + 1, j + 1], [j, j + 1, j, j + 1]] = np.cos(t), -np.sin(t), np.sin(t), np.cos(t)
        turn = turn @ g
    back = turn.T @ load
    new = {c: sum((F.col(a) * float(back[i, k]) for i, a in enumerate(names)), F.lit(float(means[c] or 0.0))) for k, c in enumerate(columns)}
    return pcs.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def _nearest(df: DataFrame, columns: list[str], k: int, seed: int, within: str | None = None) -> DataFrame:
    """df with __n, the k nearest other rows of the row's series (structs d, i, o of squared distance, idx, columns and y), nearest first.

    |projection difference| <= |w| * distance, so no block further away than
    the k-th distance within the own block can hold a nearer row.  Of equally
    near rows those of the own block come first.
    """
    rng = np.random.default_rng(seed)
    w = rng.normal(size=len(columns))
    keys = ["Ticker"] + ([within] if within else [])
    proj = sum((F.col(c) * float(x) for c, x in zip(columns, w)), F.lit(0.0))
    series = Window.partitionBy(*keys)
    known = F.col("__v").isNotNull() & ~F.isnan("__v")
    placed = df.withColumn("__v", proj).withColumn("__m", F.count(F.when(known, 1)).over(series)).withColumn("__r", F.when(known, F.row_number().over(series.orderBy(F.when(known, 0).otherwise(1), "__v", "idx"))))
    blocks = F.greatest(F.lit(1), F.floor(F.col("__m") / max(BLOCK, 2 * k + 2)))
    ranked = placed.withColumn("__b", F.floor((F.col("__r") - 1) * blocks / F.col("__m"))).drop("__m", "__r")
    other = ranked.where(known).select(*keys, "__b", "__v", F.struct(F.col("idx").alias("idx"), *columns, "y").alias("o"))
    held = other.groupBy(*keys, "__b").agg(F.collect_list("o").alias("__o"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    dist = lambda o: sum(((F.col(c) - o[c]) * (F.col(c) - o[c]) for c in columns), F.lit(0.0))
    each = F.transform(F.filter("__o", lambda o: o["idx"] != F.col("idx")), lambda o: F.struct(dist(o).alias("d"), o["idx"].alias("i"), o.alias("o")))
    first = ranked.join(held.drop("__lo", "__hi").hint("merge"), [*keys, "__b"], "left").withColumn("__n", F.coalesce(F.slice(F.array_sort(each), 1, k), F.slice(F.array_sort(each), 1, 0))).drop("__o")
    bound = F.when(F.size("__n") == k, F.element_at("__n", -1)["d"])  # fewer only where the series is one block
    # A little more than the bound, against rounding; nothing is nearer than 0.
    reach = F.sqrt(bound) * float(np.sqrt((w * w).sum()) * (1 + 1e-9)) + 1e-12 * F.abs("__v")
    asks = first.where(known & (bound > 0)).select(*keys, "idx", *columns, "__b", "__v", bound.alias("__d"), reach.alias("__reach"))
    # Blocks are in order of the projection: the first and the last within reach by running counts over rows' ends and blocks' edges.
    ends = lambda d, at, kind, row: d.select(*keys, at.alias("__at"), F.lit(kind).alias("__kind"), row.alias("__row"))
    none = F.lit(None).cast("long")

    def passed(edges: DataFrame, edge: str, at, kind: int, name: str) -> DataFrame:
        both = ends(edges, F.col(edge), 1, none).union(ends(asks, at, kind, F.col("idx").cast("long")))
        n = F.sum(F.when(F.col("__kind") == 1, 1).otherwise(0)).over(series.orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0))
        return both.withColumn(name, n).where("__kind != 1").select(*keys, F.col("__row").alias("idx"), name)

    low = passed(held, "__hi", F.col("__v") - F.col("__reach"), 0, "__from")
    high = passed(held, "__lo", F.col("__v") + F.col("__reach"), 2, "__to")
    range_ = asks.join(low.hint("merge"), [*keys, "idx"]).join(high.hint("merge"), [*keys, "idx"])
    more = range_.withColumn("__x", F.explode(F.filter(F.sequence("__from", F.greatest(F.col("__from"), F.col("__to") - 1)), lambda x: x != F.col("__b"))))
    met = more.drop("__b").withColumnRenamed("__x", "__b").join(held.drop("__lo", "__hi").hint("merge"), [*keys, "__b"])
    near = F.slice(F.array_sort(F.filter(each, lambda x: x["d"] < F.col("__d"))), 1, k)
    found = met.select(*keys, "idx", near.alias("__f")).where(F.size("__f") > 0).groupBy(*keys, "idx").agg(F.flatten(F.collect_list("__f")).alias("__f"))
    out = first.join(found.hint("merge"), [*keys, "idx"], "left")
    every = F.when(F.col("__f").isNull(), F.col("__n")).otherwise(F.slice(F.array_sort(F.concat("__n", "__f")), 1, k))
    return out.withColumn("__n", every).drop("__v", "__b", "__f")


def _partners(df: DataFrame, columns: list[str], k: int, seed: int, tag: str, within: str | None = None) -> DataFrame:
    """df with __p, one of the row's k nearest rows (a struct of columns and y), chosen by hash."""
    joined = _nearest(df, columns, k, seed, within)
    pick = F.floor(uniform(seed, f"{tag}/pick", "Ticker", "idx") * F.size("__n")).cast("int")
    return joined.withColumn("__p", F.get("__n", pick)["o"]).drop("__n")


def pattern_morph(df: DataFrame, columns: list[str], alpha: float = 0.5, k: int = 5, seed: int = 42, copy: int = 0) -> DataFrame:
    """Each row moved by a share below alpha toward one of its k nearest rows, X and y; a row without neighbour stays."""
    lam = alpha * uniform(seed, f"morph/{copy}", "Ticker", "idx")
    wide = _partners(df, columns, k, seed, f"morph/{copy}").withColumn("__l", F.when(F.col("__p").isNotNull(), lam).otherwise(0.0))
    mix = lambda a, b: a + F.col("__l") * (F.coalesce(b, a) - a)
    new = {c: mix(F.col(c), F.col(f"__p.{c}")) for c in columns} | {"y": F.when(F.col("__p").isNull(), F.col("y")).otherwise(F.zip_with("y", F.col("__p.y"), mix))}
    return wide.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def smote(df: DataFrame, columns: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Originals, and for half the rows of each fifth of the targets one between the row and a near one of the same fifth."""
    y0 = F.get("y", F.lit(0))
    cuts = quantiles(df, {"y": (y0, [0.2, 0.4, 0.6, 0.8])})["y"]
    fifth = df.withColumn("__g", sum((F.coalesce(F.lit(c) < y0, F.lit(False)).cast("int") for c in cuts), F.lit(0)))
    order = Window.partitionBy("Ticker", "__g").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "Ticker", F.col("idx").cast("string"))))
    size = F.count("*").over(Window.partitionBy("Ticker", "__g"))
    some = _partners(fifth, columns, k, seed, "smote", "__g").withColumns({"__r": F.row_number().over(order), "__s": size}).where("__r * 2 <= __s AND __p IS NOT NULL")
    some = some.withColumn("__l", uniform(seed, "smote/l", "Ticker", "idx"))
    mix = lambda a, b: a + F.col("__l") * (b - a)
    new = {c: mix(F.col(c), F.col(f"__p.{c}")) for c in columns} | {"y": F.zip_with("y", F.col("__p.y"), mix)}
    return df.unionByName(some.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns]))
