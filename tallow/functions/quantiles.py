"""Exact quantiles of whole columns, by narrowing value ranges pass by pass.

``percentile`` merges a map of all distinct values into one task.  Here each
quantile keeps a range of values that holds its rank: a pass counts the rows
below and within the range exactly and, in the same scan, takes a mergeable
sketch of the values within, whose error bound gives the next and smaller
range.  Should a sketch miss the rank, the counts show it and the range is
taken from the side where the rank is.  Ranges of few rows end in one count by
value; nothing but counts, sketches and these last rows is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallow.functions import scratch

#: A sketch finds ranks to within one part in so many.
ACCURACY = 2000
#: Rows of a range that are counted value by value.
FEW = 4096


@dataclass
class _Target:
    """The rank, from 0, of a column; it lies among the inside rows strictly between low and high, None being no bound."""

    column: str
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def within(self) -> Column:
        x, keep = F.col(self.column), F.col(self.column).isNotNull()
        keep = keep if self.low is None else keep & (x > F.lit(self.low))
        return keep if self.high is None else keep & (x < F.lit(self.high))

    def done(self) -> bool:
        return self.value is not None or self.inside <= FEW


def _narrow(rows: DataFrame, targets: list[_Target]) -> None:
    """One pass: sketches within the ranges, then counts of what they propose."""
    sketches = []
    for k, t in enumerate(targets):
        at, slack = (t.rank - t.below) / t.inside, 2 / ACCURACY
        share = F.array(F.lit(max(0.0, at - slack)), F.lit(min(1.0, at + slack)))
        sketches.append(F.percentile_approx(F.when(t.within(), F.col(t.column)), share, ACCURACY).alias(f"s{k}"))
    found = rows.agg(*sketches).first()
    counts = []
    for k, t in enumerate(targets):
        x, (a, b) = F.col(t.column), found[k]
        counts += [F.count_if(x < a), F.count_if((x >= a) & (x <= b)), F.count_if(x == a), F.count_if(x == b)]
    n = rows.agg(*[c.alias(f"n{k}") for k, c in enumerate(counts)]).first()
    for k, t in enumerate(targets):
        (a, b), (below, inside, at_a, at_b) = found[k], n[4 * k : 4 * k + 4]
        if t.rank < below:  # the sketch missed it
            t.high, t.inside = a, below - t.below
        elif t.rank >= below + inside:
            t.low, t.below, t.inside = b, below + inside, t.below + t.inside - below - inside
        elif t.rank < below + at_a or t.rank >= below + inside - at_b:
            t.value = a if t.rank < below + at_a else b
        else:  # the ends are settled, so that every pass gets on, however frequent values are
            t.low, t.high, t.below, t.inside = a, b, below + at_a, inside - at_a - at_b


def _count_values(rows: DataFrame, targets: list[_Target]) -> None:
    each = F.array_compact(F.array(*[F.when(t.within(), F.struct(F.lit(k).alias("k"), F.col(t.column).alias("x"))) for k, t in enumerate(targets)]))
    values = rows.select(F.explode(each).alias("v")).groupBy("v.k", "v.x").count()
    so_far = F.sum("count").over(Window.partitionBy("k").orderBy("x"))  # FEW rows of a target, or not many more
    rank = F.element_at(F.array(*[F.lit(t.rank) for t in targets]), F.col("k") + 1)
    below = F.element_at(F.array(*[F.lit(t.below) for t in targets]), F.col("k") + 1)
    placed = values.withColumns({"s": so_far, "r": rank - below}).where((F.col("r") < F.col("s")) & (F.col("r") >= F.col("s") - F.col("count")))
    for row in placed.select("k", "x").collect():  # one row a target
        targets[row["k"]].value = row["x"]


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]) -> dict[str, list[float | None]]:
    """By name: the quantiles of an expression over all rows, between ranks by interpolation; None without values.

    Null and NaN are missing.  The expressions are written once.
    """
    clean = {f"__q{k}": x.cast("double") for k, (x, _) in enumerate(wanted.values())}
    rows = df.select(*[F.when(~F.isnan(x), x).alias(c) for c, x in clean.items()])
    rows = scratch.table(rows, "quantiles")
    sizes = rows.agg(*[F.count(c) for c in clean]).first()
    targets: dict[tuple[str, int], _Target] = {}
    for c, n, (_, shares) in zip(clean, sizes, wanted.values()):
        for p in shares if n else []:
            at = p * (n - 1)
            for rank in {int(at), min(int(at) + 1, n - 1)}:
                targets[c, rank] = _Target(c, rank, n)
    while todo := [t for t in targets.values() if not t.done()]:
        _narrow(rows, todo)
    if few := [t for t in targets.values() if t.value is None]:
        _count_values(rows, few)
    out: dict[str, list[float | None]] = {}
    for name, c, n, (_, shares) in zip(wanted, clean, sizes, wanted.values()):
        out[name] = []
        for p in shares:
            at = p * (n - 1)
            low = int(at) if n else 0
            pair = [targets[c, r].value for r in (low, min(low + 1, n - 1))] if n else None
            out[name].append(None if pair is None else pair[0] if at == low else (low + 1 - at) * pair[0] + (at - low) * pair[1])
    return out
