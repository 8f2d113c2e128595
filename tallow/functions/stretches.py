"""Long series in stretches: windows, row numbers and running sums without one task for a series.

Rows of a series are numbered by a scan over range-partitioned pieces.  A
stretch is a fixed count of numbered rows; a copy of its last rows, the halo,
goes to the next stretch, so that a window that looks back no further than the
halo is computed within (Ticker, stretch) and equals the window over the whole
series.  Running sums add a stretch's own sums to what the stretches before it
sum to.  Nothing is sorted or held by a task but one stretch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallow.functions import scratch
from tallow.functions.windows import within_stretches

#: Rows of a stretch where none are asked for.
LENGTH = 1 << 19
#: Estimated bytes of a frame from which its series are counted, and split if one has more than a stretch.
AUTO_BYTES = 1 << 30


def automatic(df: DataFrame) -> int | None:
    """LENGTH if some series is longer, else None; frames that are small by their plan's estimate are not counted."""
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < AUTO_BYTES:
        return None
    most = df.groupBy("Ticker").count().agg(F.max("count")).first()[0] or 0
    return LENGTH if most > LENGTH else None


def _key() -> Column:
    return F.col("Ticker").eqNullSafe(F.col("__t"))


def numbered(df: DataFrame, length: int = LENGTH) -> DataFrame:
    """df with __row, the place (from 1) of a row in its series; rows of equal time in any order.

    df is written once before and once after the range partitioning, whose
    pieces are only true of one run.
    """
    base = scratch.table(df, "series")
    pieces = 1 + base.count() // length
    cut = base.repartitionByRange(pieces, "Ticker", "Datetime").sortWithinPartitions("Ticker", "Datetime")
    cut = scratch.table(cut.withColumns({"__piece": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}), "pieces")
    sizes = cut.groupBy(F.col("Ticker").alias("__t"), F.col("__piece").alias("__p")).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("__t").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each piece of a series
    starts = scratch.table(sizes.select("__t", "__p", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift")), "starts")
    out = cut.join(starts.hint("merge"), _key() & (F.col("__piece") == F.col("__p")))
    return scratch.table(out.withColumn("__row", F.col("__id") + F.col("__shift")).drop("__piece", "__id", "__t", "__p", "__shift"), "numbered")


def _stretch(length: int) -> Column:
    return F.floor((F.col("__row") - 1) / length)


def haloed(df: DataFrame, length: int, behind: int, ahead: int = 0) -> DataFrame:
    """Numbered rows with __stretch, and copies of those that neighbouring stretches see; __own is false for copies."""
    if max(behind, ahead) > length:
        raise ValueError(f"a stretch of {length} rows is shorter than a look at {max(behind, ahead)} rows")
    place = (F.col("__row") - 1) % length
    home = _stretch(length)
    at = lambda s, own: F.struct(s.alias("s"), F.lit(own).alias("own"))
    copies = F.array_compact(F.array(at(home, True), F.when(place >= length - behind, at(home + 1, False)), F.when((place < ahead) & (home > 0), at(home - 1, False))))
    out = df.withColumn("__c", F.explode(copies))
    return out.withColumns({"__stretch": F.col("__c.s"), "__own": F.col("__c.own")}).drop("__c")


def in_stretches(df: DataFrame, make: Callable[[DataFrame], DataFrame], behind: int, ahead: int = 0, length: int = LENGTH) -> DataFrame:
    """make(df), whose windows over a series look back and ahead no further than that, stretch by stretch.

    make gets df with more rows and columns and must keep them; it may drop
    rows, but for copies that its windows need.
    """
    rows = df if "__row" in df.columns else numbered(df, length)
    with within_stretches():
        out = make(haloed(rows, length, behind, ahead))
    out = out.where("__own").drop("__own", "__stretch")
    return out if "__row" in df.columns else out.drop("__row")


def running_sums(df: DataFrame, sums: dict[str, str], length: int = LENGTH) -> DataFrame:
    """Numbered rows with the sums of columns over all rows of the series so far; null until there is a value."""
    rows = df.withColumn("__stretch", _stretch(length))
    names = list(sums)
    totals = rows.groupBy(F.col("Ticker").alias("__t"), F.col("__stretch").alias("__s")).agg(*[F.sum(sums[n]).alias(f"__sum{k}") for k, n in enumerate(names)])
    before = Window.partitionBy("__t").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # one row for each stretch of a series
    carried = scratch.table(totals.select("__t", "__s", *[F.sum(f"__sum{k}").over(before).alias(f"__carry{k}") for k in range(len(names))]), "carries")
    rows = rows.join(carried.hint("merge"), _key() & (F.col("__stretch") == F.col("__s")))
    so_far = Window.partitionBy("Ticker", "__stretch").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    local = {k: F.sum(sums[n]).over(so_far) for k, n in enumerate(names)}
    both = [F.coalesce(local[k] + F.col(f"__carry{k}"), local[k], F.col(f"__carry{k}")).alias(n) for k, n in enumerate(names)]
    return rows.select(*df.columns, *both)
