"""Expressions over candles as SQL text, for Spark and for the engine that checks it.

An indicator is a formula over named columns.  Formulas are written once
against this small vocabulary; each dialect fills in how it divides without
raising, where it puts a frame, and how it spells an array function.
"""

from __future__ import annotations

ORDER = "PARTITION BY Ticker ORDER BY Datetime"


class Spark:
    """Spark SQL text."""

    spark = True
    order = ORDER

    def row_number(self) -> str:
        return f"row_number() OVER ({self.order})"

    def div(self, a: str, b: str) -> str:
        """Null where b is 0."""
        return f"try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"

    def ln(self, x: str) -> str:
        return f"CASE WHEN {x} > 0 THEN ln({x}) END"

    def root(self, x: str) -> str:
        return f"CASE WHEN {x} >= 0 THEN sqrt({x}) END"

    def lag(self, x: str, k: int) -> str:
        return f"lag({x}, {k}) OVER ({self.order})" if k >= 0 else f"lead({x}, {-k}) OVER ({self.order})"

    def frame(self, call: str, lo: int | None, hi: int = 0) -> str:
        """call over the rows from lo before (None: all) to hi before the current one."""
        first = "UNBOUNDED PRECEDING" if lo is None else f"{lo} PRECEDING"
        last = "CURRENT ROW" if hi == 0 else f"{hi} PRECEDING"
        return f"{call} OVER ({self.order} ROWS BETWEEN {first} AND {last})"

    def full(self, fn: str, x: str, k: int, shift: int = 0) -> str:
        """fn of x over the last k rows, null unless all k are there."""
        n = self.frame(f"count({x})", k - 1 + shift, shift)
        return f"CASE WHEN {n} = {k} THEN {self.frame(f'{fn}({x})', k - 1 + shift, shift)} END"

    def flag(self, c: str) -> str:
        return f"CAST(coalesce({c}, false) AS INT)"

    def skew(self, x: str, k: int) -> str:
        """Bias-corrected skewness; 0 in a flat window."""
        flat = f"{self.full('max', x, k)} = {self.full('min', x, k)}"
        return f"CASE WHEN {flat} THEN 0.0 ELSE {self.full('skewness', x, k)} * sqrt({k}.0 * {k - 1}) / {k - 2} END"

    def kurt(self, x: str, k: int) -> str:
        """Bias-corrected excess kurtosis; -3 in a flat window."""
        flat = f"{self.full('max', x, k)} = {self.full('min', x, k)}"
        return f"CASE WHEN {flat} THEN -3.0 ELSE ({k - 1}.0 / (({k - 2}) * ({k - 3}))) * (({k + 1}) * ({self.full('kurtosis', x, k)}) + 6) END"

    def window_list(self, x: str, k: int) -> str:
        """The last k values as an array, null unless all are there; oldest first."""
        n = self.frame(f"count({x})", k - 1)
        return f"CASE WHEN {n} = {k} THEN {self.frame(f'collect_list({x})', k - 1)} END"

    def mean_abs_dev(self, xs: str, k: int) -> str:
        total = f"aggregate({xs}, 0D, (s, x) -> s + x)"
        return f"aggregate(transform({xs}, x -> abs(x - {total} / {k})), 0D, (s, x) -> s + x) / {k}"

    def place(self, xs: str, what: str) -> str:
        """Places before the first greatest (max) or least (min) value."""
        return f"array_position({xs}, array_{what}({xs})) - 1"

    def entropy(self, xs: str, bins: int, k: int) -> str:
        lo, hi = f"array_min({xs})", f"array_max({xs})"
        at = f"transform({xs}, x -> least(CAST(floor({bins} * (x - {lo}) / ({hi} - {lo})) AS INT), {bins - 1}))"
        each = f"transform(sequence(0, {bins - 1}), b -> size(filter({at}, y -> y = b)) / {k}D)"
        return f"CASE WHEN {hi} = {lo} THEN 0D WHEN {xs} IS NOT NULL THEN aggregate({each}, 0D, (s, p) -> s - CASE WHEN p > 0 THEN p * ln(p) ELSE 0D END) END"


class Stretched(Spark):
    """Spark SQL text over stretches of numbered rows (functions.stretches)."""

    order = "PARTITION BY Ticker, __stretch ORDER BY __row"

    def row_number(self) -> str:
        return "CAST(__row AS INT)"


class Duck(Spark):
    """DuckDB text, used for the oracle only."""

    spark = False

    def div(self, a: str, b: str) -> str:
        return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"

    def skew(self, x: str, k: int) -> str:
        flat = f"{self.full('max', x, k)} = {self.full('min', x, k)}"
        return f"CASE WHEN {flat} THEN 0.0 ELSE {self.full('skewness', x, k)} END"

    def kurt(self, x: str, k: int) -> str:
        flat = f"{self.full('max', x, k)} = {self.full('min', x, k)}"
        return f"CASE WHEN {flat} THEN -3.0 ELSE {self.full('kurtosis', x, k)} END"

    def window_list(self, x: str, k: int) -> str:
        n = self.frame(f"count({x})", k - 1)
        return f"CASE WHEN {n} = {k} THEN {self.frame(f'list({x})', k - 1)} END"

    def mean_abs_dev(self, xs: str, k: int) -> str:
        return f"list_avg(list_transform({xs}, lambda x: abs(x - list_avg({xs}))))"

    def place(self, xs: str, what: str) -> str:
        return f"list_position({xs}, list_{what}({xs})) - 1"

    def entropy(self, xs: str, bins: int, k: int) -> str:
        lo, hi = f"list_min({xs})", f"list_max({xs})"
        at = f"list_transform({xs}, lambda x: least(CAST(floor({bins} * (x - {lo}) / nullif({hi} - {lo}, 0)) AS INT), {bins - 1}))"
        each = f"list_transform(range(0, {bins}), lambda b: len(list_filter({at}, lambda y: y = b)) / {k}.0)"
        return f"CASE WHEN {hi} = {lo} THEN 0.0 WHEN {xs} IS NOT NULL THEN -list_sum(list_transform({each}, lambda p: CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0 END)) END"

    def recurrence(self, a: str, b: str) -> str:
        """y of y = a y' + b over all rows so far, by composing the maps."""
        pairs = self.frame(f"list(struct_pack(a := CAST({a} AS DOUBLE), b := CAST({b} AS DOUBLE)))", None)
        step = "struct_pack(a := p.a * q.a, b := CASE WHEN q.a = 0 THEN q.b ELSE q.a * p.b + q.b END)"
        return f"struct_extract(list_reduce({pairs}, lambda p, q: {step}), 'b')"
