"""Linear recurrences along series, all of a set in one pass.

Exponential means, means of means, and any y_t = a_t y_(t-1) + b_t together
are one linear system: the state after a row is an affine map of the state
before it, and affine maps compose.  Rows are range-partitioned by series and
time, so that a long series spans many partitions; each stretch of a series in
a partition folds to one small map, a scan over these maps gives every
stretch's carry-in, and the stretches unfold with it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallow.functions import scratch

#: Rows of a partition, about; its task holds their inputs and results.
PARTITION_ROWS = 1 << 19
#: Rows worked on at once inside a task.
BLOCK = 2048


@dataclass(frozen=True)
class Mean:
    """Exponential mean of a sum of columns or earlier recurrences, each times a factor.

    It starts at the first row where its inputs are there; later gaps carry it on.
    """

    name: str
    of: tuple[tuple[str, float], ...]
    span: int


@dataclass(frozen=True)
class Affine:
    """y = a y' + b for two SQL texts; a = 0 starts anew, a null makes y null until then."""

    name: str
    a: str
    b: str


class System:
    """Recurrences in an order in which each comes after those it takes in, and the input columns they need."""

    def __init__(self, parts: Iterable[Mean | Affine]):
        todo, self.parts, names = list(parts), [], set()
        own = {p.name for p in todo}
        while todo:
            ready = [p for p in todo if isinstance(p, Affine) or all(x in names or x not in own for x, _ in p.of)]
            if not ready:
                raise ValueError("recurrences take each other in")
            self.parts += ready
            names |= {p.name for p in ready}
            todo = [p for p in todo if p not in ready]
        self.place = {p.name: j for j, p in enumerate(self.parts)}
        self.inputs = sorted({x for p in self.parts if isinstance(p, Mean) for x, _ in p.of if x not in own})
        #: Input columns whose first values, all of them, start a mean.
        self.roots: dict[str, frozenset[str]] = {}
        for p in self.parts:
            if isinstance(p, Mean):
                self.roots[p.name] = frozenset().union(*[self.roots.get(x, frozenset([x])) for x, _ in p.of])

    def columns(self) -> dict[str, str]:
        """Input columns by name: SQL text."""
        out = {f"__x{k}": x for k, x in enumerate(self.inputs)}
        for j, p in enumerate(self.parts):
            if isinstance(p, Affine):
                out |= {f"__a{j}": p.a, f"__b{j}": p.b}
        return out

    def run(self, cols: dict[str, np.ndarray], when: np.ndarray, state: np.ndarray, on: np.ndarray) -> np.ndarray:
        """States (rows, recurrences, columns of state) after each row; only columns with on take the inputs in."""
        n = len(when)
        out = np.zeros((n, len(self.parts), len(on)))
        for j, p in enumerate(self.parts):
            if isinstance(p, Affine):
                a, b = cols[f"__a{j}"], np.where(on, cols[f"__b{j}"][:, None], 0.0)
            else:
                x, gap, keep = np.zeros((n, len(on))), np.zeros(n, bool), 1 - 2 / (p.span + 1)
                for name, factor in p.of:
                    if name in self.place:
                        x = x + factor * out[:, self.place[name]]
                    else:
                        value = cols[f"__x{self.inputs.index(name)}"]
                        gap |= np.isnan(value)
                        x = x + np.where(on, factor * np.nan_to_num(value)[:, None], 0.0)
                first = np.max([cols[f"__t{self.inputs.index(r)}"] for r in self.roots[p.name]], axis=0)
                a = np.where(when <= first, 0.0, np.where(gap, 1.0, keep))
                b = np.where((when < first)[:, None], 0.0, np.where((when == first)[:, None], x, np.where(gap[:, None], 0.0, (1 - keep) * x)))
            a, b = _prefixes(a, b)
            out[:, j] = np.where((a == 0)[:, None], b, a[:, None] * state[j] + b)
        return out

    def absent(self, cols: dict[str, np.ndarray], when: np.ndarray) -> np.ndarray:
        """(rows, recurrences): means that have not started."""
        return np.column_stack([np.zeros(len(when), bool) if isinstance(p, Affine) else when < np.max([cols[f"__t{self.inputs.index(r)}"] for r in self.roots[p.name]], axis=0) for p in self.parts])


def _prefixes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps y -> a y + b of the rows, each composed with all before it, by doubling."""
    a, b, s = a.astype(float), b.astype(float), 1
    while s < len(a):
        anew = a[s:] == 0
        b[s:] = np.where(anew[:, None], b[s:], a[s:, None] * b[:-s] + b[s:])
        a[s:] = np.where(anew, 0.0, a[s:] * a[:-s])
        s *= 2
    return a, b


def _apply(last: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The state after a stretch whose map is last (recurrences, 1 + recurrences); what a factor of 0 hides may be NaN."""
    with np.errstate(invalid="ignore"):
        return last[:, 0] + np.where(last[:, 1:] == 0, 0.0, last[:, 1:] * state).sum(1)


def _nullable(schema: T.StructType) -> T.StructType:
    """Schema with nulls allowed everywhere, as Arrow gives columns back."""
    text = schema.json()
    for what in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{what}":false', f'"{what}":true')
    return T.StructType.fromJson(json.loads(text))


_FAR = np.iinfo(np.int64).max


def _blocks(system: System, table: pa.Table):
    """(rows' place, inputs, times) of a stretch, in order, block by block."""
    when = table.column("__when").to_numpy()
    order = np.argsort(when, kind="stable")
    get = lambda c: table.column(c).to_numpy(zero_copy_only=False)
    cols = {c: get(c).astype(float)[order] for c in system.columns()}
    cols |= {f"__t{k}": table.column(f"__t{k}").fill_null(_FAR).to_numpy()[order] for k in range(len(system.inputs))}
    for at in range(0, len(order), BLOCK):
        part = slice(at, at + BLOCK)
        yield order[part], {c: v[part] for c, v in cols.items()}, when[order[part]]


def _fold(system: System):
    n = len(system.parts)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        state, on = np.column_stack([np.zeros(n), np.eye(n)]), np.arange(n + 1) == 0
        for _, cols, when in _blocks(system, table):
            state = system.run(cols, when, state, on)[-1]
        return pa.table({"__series": table.column("__series").slice(0, 1), "__chunk": pa.array([key[1].as_py()], pa.int32()), "__map": pa.array([state.ravel().tolist()], pa.list_(pa.float64()))})

    return run


def _scan(system: System):
    n = len(system.parts)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunk = table.column("__chunk").to_numpy()
        state, states = np.full(n, np.nan), [None] * len(chunk)
        for i in np.argsort(chunk).tolist():
            states[i] = state.tolist()
            state = _apply(np.array(table.column("__map")[i].as_py()).reshape(n, n + 1), state)
        return pa.table({"__series": table.column("__series"), "__chunk": table.column("__chunk"), "__state": pa.array(states, pa.list_(pa.float64()))})

    return run


def _unfold(system: System, keep: list[str]):
    n = len(system.parts)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        state = np.array(right.column("__state")[0].as_py())
        made = np.zeros((left.num_rows, n))
        for order, cols, when in _blocks(system, left):
            out = system.run(cols, when, state[:, None], np.array([True]))[:, :, 0]
            state = out[-1]
            made[order] = np.where(system.absent(cols, when), np.nan, out)
        columns = [pa.array(made[:, j], mask=np.isnan(made[:, j])) for j in range(n)]
        return pa.Table.from_arrays([*[left.column(c) for c in keep], *columns], [*keep, *[p.name for p in system.parts]])

    return run


def linear_recurrences(df: DataFrame, parts: Iterable[Mean | Affine], key: str = "Ticker", order: str = "Datetime") -> DataFrame:
    """df with a column for each recurrence.

    Rows of one series and equal time are taken in any order.  A null key is a
    series of its own.  df is written once and read three times.
    """
    system, old = System(parts), df.columns
    made = df.select("*", *[F.expr(f"CAST({x} AS DOUBLE)").alias(c) for c, x in system.columns().items()], F.unix_micros(F.col(order).cast("timestamp")).alias("__when"), F.col(key).alias("__series"))
    base = scratch.table(made, "series")
    firsts = [F.min(F.when(F.col(f"__x{k}").isNotNull(), F.col("__when"))).alias(f"__t{k}") for k in range(len(system.inputs))]
    starts = scratch.table(base.groupBy(F.col("__series").alias("__s")).agg(F.count("*").alias("__rows"), *firsts), "starts")
    rows = starts.agg(F.sum("__rows")).first()[0] or 0
    cut = base.join(starts.drop("__rows"), F.col("__series").eqNullSafe(F.col("__s"))).drop("__s")
    cut = cut.repartitionByRange(1 + rows // PARTITION_ROWS, "__series", "__when").withColumn("__chunk", F.spark_partition_id())
    cut = scratch.table(cut, "stretches")  # a partition's number is only true of this one run
    series = base.schema["__series"].dataType
    field = lambda c, t: T.StructField(c, t)
    part = T.StructType([field("__series", series), field("__chunk", T.IntegerType())])
    numbers = T.ArrayType(T.DoubleType())
    inputs = ["__series", "__chunk", "__when", *system.columns(), *[f"__t{k}" for k in range(len(system.inputs))]]
    maps = cut.select(*inputs).groupBy("__series", "__chunk").applyInArrow(_fold(system), T.StructType([*part.fields, field("__map", numbers)]))
    states = maps.groupBy("__series").applyInArrow(_scan(system), T.StructType([*part.fields, field("__state", numbers)]))
    schema = T.StructType([*_nullable(cut.select(*old).schema).fields, *[field(p.name, T.DoubleType()) for p in system.parts]])
    pairs = cut.groupBy("__series", "__chunk").cogroup(states.groupBy("__series", "__chunk"))
    return pairs.applyInArrow(_unfold(system, old), schema)
