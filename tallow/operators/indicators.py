"""The indicator registry and its planner.

An indicator is a formula (see functions.dialect) over named columns: candle
columns Open, High, Low, Close, Volume, shared intermediates and other
indicators.  The planner orders what is asked for by dependency into levels
and emits one ``select`` per level, so that all windows of a level share one
sort; recurrences, those that take each other in too, are solved in one pass.  Every indicator is shifted
by one row at the end, so that a row knows only the rows before it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallow.functions import scratch
from tallow.functions.dialect import Spark, Stretched
from tallow.functions.recurrence import Affine, Mean, linear_recurrences
from tallow.functions.stretches import automatic, haloed, numbered, running_sums

CANDLE = ("Open", "High", "Low", "Close", "Volume")
Formula = Callable[[Spark], str]


@dataclass
class Recurrence:
    """y = a y' + b; both formulas.  An exponential mean also says of what sum (name, factor), and its span."""

    a: Formula
    b: Formula
    of: tuple[tuple[str, float], ...] = ()
    span: int = 0

    def part(self, name: str, d: Spark) -> Mean | Affine:
        return Mean(name, self.of, self.span) if self.of else Affine(name, self.a(d), self.b(d))


@dataclass
class Running:
    """The sum of a column over all rows so far."""

    of: str


@dataclass
class Indicator:
    name: str
    group: str
    formula: Formula | Recurrence | Running
    inputs: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)


class Registry:
    """Indicators by name; helpers are formulas that only others use."""

    def __init__(self) -> None:
        self.indicators: dict[str, Indicator] = {}
        self.helpers: dict[str, Formula | Recurrence] = {}

    def register(self, name: str, group: str, formula: Formula | Recurrence | Running, inputs: Iterable[str] = (), **params) -> None:
        self.indicators[name] = Indicator(name, group, formula, tuple(inputs), params)

    def helper(self, name: str, formula: Formula | Recurrence) -> None:
        self.helpers[name] = formula

    def categories(self) -> list[str]:
        return sorted({i.group for i in self.indicators.values()})

    def by_category(self, group: str) -> list[str]:
        return [n for n, i in self.indicators.items() if i.group == group]

    def formula(self, name: str) -> Formula | Recurrence | Running:
        return self.indicators[name].formula if name in self.indicators else self.helpers[name]

    def texts(self, name: str, d: Spark) -> list[str]:
        f = self.formula(name)
        if isinstance(f, Running):
            return [d.frame(f"sum({f.of})", None)]
        return [f.a(d), f.b(d)] if isinstance(f, Recurrence) else [f(d)]

    def reach(self, name: str, d: Spark) -> int:
        """Rows that the formula itself looks back."""
        text = " ".join(self.texts(name, d))
        return max((int(k) for pair in re.findall(r"\b(\d+) PRECEDING|lag\(\w+, (\d+)\)", text) for k in pair if k), default=0)

    def needs(self, name: str, d: Spark) -> set[str]:
        """Registered names that the formula mentions."""
        found = {x for t in self.texts(name, d) for x in re.findall(r"[A-Za-z_]\w*", t)}
        return {x for x in found if x in self.indicators or x in self.helpers} - {name}

    def variant(self, name: str, value: int, d: Spark | None = None) -> str:
        """The name of an indicator like name with another window, span or period; it is registered, with the helpers it needs.

        The number stands in the names of helpers of the same number, too.
        """
        d = d or Spark()
        old = next(iter(self._numbers(name)), None)
        if old is None:
            raise ValueError(f"{name} has no parameter")
        new = re.sub(rf"_{old}(?=_|$)", f"_{value}", name, count=1)
        if new in self.indicators or new in self.helpers:
            return new
        f = self.formula(name)
        arg = next(iter(f.__defaults__ and f.__code__.co_varnames[1:2] or ()), None) if not isinstance(f, Recurrence) else None
        if isinstance(f, Running):
            raise ValueError(f"{name} has no parameter")
        if isinstance(f, Recurrence):
            if not f.of or len(f.of) != 1 or f.span != old:
                raise ValueError(f"{name} can't take another number")
            made: Formula | Recurrence = ema(f.of[0][0], value)
        elif arg and f.__defaults__[0] == old:
            made = lambda x: f(x, **{arg: value})
        else:
            raise ValueError(f"{name} can't take another number")
        if name in self.indicators:
            i = self.indicators[name]
            self.register(new, i.group, made, i.inputs, **{k: value if v == old else v for k, v in i.params.items()})
        else:
            self.helper(new, made)
        for need in {x for t in self.texts(new, d) for x in re.findall(r"[A-Za-z_]\w*", t)}:
            base = re.sub(rf"_{value}(?=_|$)", f"_{old}", need, count=1)
            if need != base and need not in self.indicators and need not in self.helpers and (base in self.indicators or base in self.helpers):
                self.variant(base, value, d)
        return new

    def _numbers(self, name: str) -> list[int]:
        params = self.indicators[name].params.values() if name in self.indicators else ()
        return [v for v in params if isinstance(v, int)] or [int(x) for x in re.findall(r"_(\d+)(?=_|$)", name)][:1]

    def summary(self, spark) -> DataFrame:
        """(name, category, inputs, params) of every indicator."""
        rows = [(n, i.group, ",".join(i.inputs), ",".join(f"{k}={v}" for k, v in i.params.items())) for n, i in self.indicators.items()]
        return spark.createDataFrame(rows, "name string, category string, inputs string, params string")

    def inputs_of(self, name: str, d: Spark | None = None) -> set[str]:
        """Candle columns that an indicator is made from."""
        d = d or Spark()
        own = {x for t in self.texts(name, d) for x in re.findall(r"[A-Za-z_]\w*", t) if x in CANDLE}
        return own.union(*[self.inputs_of(x, d) for x in self.needs(name, d)])

    def levels(self, names: Iterable[str], d: Spark) -> list[list[str]]:
        """All that names need, themselves included, each after what it needs."""
        depth: dict[str, int] = {}

        def visit(name: str) -> int:
            if name not in depth:
                depth[name] = 1 + max((visit(x) for x in self.needs(name, d)), default=-1)
            return depth[name]

        for n in names:
            visit(n)
        out: list[list[str]] = [[] for _ in range(max(depth.values(), default=-1) + 1)]
        for n, k in depth.items():
            out[k].append(n)
        return out


REGISTRY = Registry()
_add, _help = REGISTRY.register, REGISTRY.helper


def ema(x: str, span: int, **of: float) -> Recurrence:
    """Exponential mean without adjustment; starts at the first value, an inner gap carries the mean on.

    of says what x is the sum of, if that is recurrences of the same pass: name=factor.
    """
    keep = 1 - 2 / (span + 1)
    alpha = 2 / (span + 1)

    first = lambda d: f"{d.frame(f'count({x})', None)} = 1 AND {x} IS NOT NULL"

    def a(d: Spark) -> str:
        return f"CASE WHEN {first(d)} THEN 0.0 WHEN {x} IS NULL THEN 1.0 ELSE {keep!r} END"

    def b(d: Spark) -> str:
        none = f"{d.frame(f'count({x})', None)} = 0"
        return f"CASE WHEN {first(d)} THEN {x} WHEN {none} THEN NULL WHEN {x} IS NULL THEN 0.0 ELSE {alpha!r} * {x} END"

    return Recurrence(a, b, tuple(of.items()) or ((x, 1.0),), span)


# Shared intermediates.
_help("prev_close", lambda d: d.lag("Close", 1))
_help("prev_high", lambda d: d.lag("High", 1))
_help("prev_low", lambda d: d.lag("Low", 1))
_help("ret", lambda d: d.div("Close", "prev_close") + " - 1")
_help("diff", lambda d: "Close - prev_close")
_help("tp", lambda d: "(High + Low + Close) / 3")
_help("tp_prev", lambda d: d.lag("tp", 1))
_help("range_", lambda d: "High - Low")
_help("gain", lambda d: "CASE WHEN diff > 0 THEN diff ELSE 0.0 END")
_help("loss", lambda d: "CASE WHEN diff < 0 THEN -diff ELSE 0.0 END")
_help("log_hl2", lambda d: f"power({d.ln(d.div('High', 'Low'))}, 2)")
_help("log_co2", lambda d: f"power({d.ln(d.div('Close', 'Open'))}, 2)")

# returns
for p in (1, 5, 10):
    _add(f"log_return_{p}", "returns", lambda d, p=p: d.ln(d.div("Close", d.lag("Close", p))), ["Close"], periods=p)
    _add(f"pct_return_{p}", "returns", lambda d, p=p: d.div("Close", d.lag("Close", p)) + " - 1", ["Close"], periods=p)
for w in (5, 10, 20):
    _help(f"ret_std_{w}", lambda d, w=w: d.full("stddev_samp", "ret", w))
    _add(f"realized_vol_{w}", "returns", lambda d, w=w: f"ret_std_{w} * sqrt(252)", ["Close"], window=w)
    _help(f"close_std_{w}", lambda d, w=w: d.full("stddev_samp", "Close", w))
    _help(f"close_avg_{w}", lambda d, w=w: d.full("avg", "Close", w))
    _add(f"zscore_close_{w}", "returns", lambda d, w=w: d.div(f"(Close - close_avg_{w})", f"close_std_{w}"), ["Close"], window=w)
_add("dpo_20", "returns", lambda d: f"{d.lag('Close', 11)} - close_avg_20", ["Close"], window=20)
_add("price_acceleration", "returns", lambda d: f"ret - {d.lag('ret', 1)}", ["Close"])
_add("gap_open_close", "returns", lambda d: "Open - prev_close", ["Open", "Close"])
_add("intraday_range", "returns", lambda d: "High - Low", ["High", "Low"])

# trend
for w in (5, 10, 20, 50, 200):
    _add(f"sma_{w}", "trend", lambda d, w=w: d.full("avg", "Close", w), ["Close"], window=w)
    _add(f"sma_{w}_ratio", "trend", lambda d, w=w: d.div("Close", f"sma_{w}") + " - 1", ["Close"], window=w)
    _add(f"ema_{w}", "trend", ema("Close", w), ["Close"], span=w)
    _add(f"ema_{w}_ratio", "trend", lambda d, w=w: d.div("Close", f"ema_{w}") + " - 1", ["Close"], span=w)
_add("wma_20", "trend", lambda d: "(" + " + ".join(f"{20 - k} * {d.lag('Close', k)}" if k else "20 * Close" for k in range(20)) + ") / 210.0", ["Close"], window=20)
_help("tp_volume", lambda d: "tp * Volume")
_add("vwma_20", "trend", lambda d: d.div(d.full("sum", "tp_volume", 20), d.full("sum", "Volume", 20)), ["High", "Low", "Close", "Volume"], window=20)
_help("hma_base", lambda d: "2 * sma_10 - sma_20")
_add("hma_20", "trend", lambda d: d.full("avg", "hma_base", 4), ["Close"], window=20)
_help("ema_20_2", ema("ema_20", 20))
_help("ema_20_3", ema("ema_20_2", 20))
_add("dema_20", "trend", lambda d: "2 * ema_20 - ema_20_2", ["Close"], span=20)
_add("tema_20", "trend", lambda d: "3 * ema_20 - 3 * ema_20_2 + ema_20_3", ["Close"], span=20)
_help("abs_diff", lambda d: "abs(diff)")
_help("row_no", lambda d: d.row_number())
for w in (10, 20):
    _help(f"kama_er_{w}", lambda d, w=w: d.div(f"abs(Close - {d.lag('Close', w)})", d.full("sum", "abs_diff", w)))
    _help(f"kama_sc_{w}", lambda d, w=w: f"power(kama_er_{w} * {2 / 3 - 2 / 31!r} + {2 / 31!r}, 2)")
    _help(
        f"kama_y_{w}",
        Recurrence(
            lambda d, w=w: f"CASE WHEN row_no <= {w + 1} THEN 0.0 ELSE 1.0 - kama_sc_{w} END",
            lambda d, w=w: f"CASE WHEN row_no <= {w} THEN NULL WHEN row_no = {w + 1} THEN Close ELSE kama_sc_{w} * Close END",
        ),
    )
    _add(f"kama_{w}", "trend", lambda d, w=w: f"kama_y_{w}", ["Close"], window=w)
_add("ma_cross_20_50", "trend", lambda d: d.flag("sma_20 > sma_50"), ["Close"])
_add("ma_spread_20_50", "trend", lambda d: d.div("(sma_20 - sma_50)", "Close"), ["Close"])
_add("slope_sma_20", "trend", lambda d: f"(2 * sma_20 + {d.lag('sma_20', 1)} - {d.lag('sma_20', 3)} - 2 * {d.lag('sma_20', 4)} + 0 * {d.lag('sma_20', 2)}) / 10.0", ["Close"])
_add("price_to_sma_20_ratio", "trend", lambda d: d.div("Close", "sma_20") + " - 1", ["Close"])
_add("price_to_ema_20_ratio", "trend", lambda d: d.div("Close", "ema_20") + " - 1", ["Close"])

# volatility
HLC = ["High", "Low", "Close"]
_add("true_range", "volatility", lambda d: "greatest(High - Low, abs(High - prev_close), abs(Low - prev_close))", HLC)
for w in (14, 20):
    _help(f"atr_h_{w}", lambda d, w=w: d.full("avg", "true_range", w))
_add("atr_14", "volatility", lambda d: "atr_h_14", HLC, window=14)
_add("atr_normalized_14", "volatility", lambda d: d.div("atr_h_14", "Close"), HLC, window=14)
_add("bbands_width_20", "volatility", lambda d: d.div("4 * close_std_20", "close_avg_20"), ["Close"], window=20)
_add("bbands_percent_b_20", "volatility", lambda d: d.div("(Close - close_avg_20 + 2 * close_std_20)", "(4 * close_std_20)"), ["Close"], window=20)
_add("keltner_width_20", "volatility", lambda d: d.div("4 * atr_h_20", "close_avg_20"), HLC, window=20)
_add("keltner_position_20", "volatility", lambda d: d.div("(Close - close_avg_20 + 2 * atr_h_20)", "(4 * atr_h_20)"), HLC, window=20)
for w in (5, 10, 14, 20):
    _help(f"high_{w}", lambda d, w=w: d.full("max", "High", w))
    _help(f"low_{w}", lambda d, w=w: d.full("min", "Low", w))
_add("donchian_width_20", "volatility", lambda d: d.div("(high_20 - low_20)", "Close"), HLC, window=20)
_add("donchian_position_20", "volatility", lambda d: d.div("(Close - low_20)", "(high_20 - low_20)"), HLC, window=20)
for w in (20, 50):
    _add(f"historical_volatility_{w}", "volatility", lambda d, w=w: f"({d.full('stddev_samp', 'ret', w)}) * sqrt(252)", ["Close"], window=w)
_add("parkinson_volatility_20", "volatility", lambda d: f"sqrt(({d.full('sum', 'log_hl2', 20)}) / {4 * 20 * math.log(2)!r}) * sqrt(252)", ["High", "Low"], window=20)
_help("gk_term", lambda d: f"0.5 * log_hl2 - {2 * math.log(2) - 1!r} * log_co2")
_help("gk_mean", lambda d: d.full("avg", "gk_term", 20))
_add("garman_klass_volatility_20", "volatility", lambda d: f"({d.root('gk_mean')}) * sqrt(252)", ["Open", *HLC], window=20)
_help("range_ema_10", ema("range_", 10))
_add("chaikin_volatility_10", "volatility", lambda d: d.div("range_ema_10", d.lag("range_ema_10", 10)) + " - 1", ["High", "Low"], window=10)

# momentum
for w in (14, 28):
    _help(f"rs_{w}", lambda d, w=w: d.div(d.full("avg", "gain", w), d.full("avg", "loss", w)))
    _add(f"rsi_{w}", "momentum", lambda d, w=w: f"100 - {d.div('100', f'(1 + rs_{w})')}", ["Close"], window=w)
_add("stoch_k_14", "momentum", lambda d: "100 * " + d.div("(Close - low_14)", "(high_14 - low_14)"), HLC, window=14)
_add("stoch_d_14_3", "momentum", lambda d: d.full("avg", "stoch_k_14", 3), HLC, window=14)
_help("rsi_pos", lambda d: "100 * " + d.div(f"(rsi_14 - ({d.full('min', 'rsi_14', 14)}))", f"(({d.full('max', 'rsi_14', 14)}) - ({d.full('min', 'rsi_14', 14)}))"))
_add("stoch_rsi_14", "momentum", lambda d: d.full("avg", "rsi_pos", 3), ["Close"], window=14)
_help("ema_12", ema("Close", 12))
_help("ema_26", ema("Close", 26))
_add("macd_12_26_9", "momentum", lambda d: "ema_12 - ema_26", ["Close"])
_add("macd_12_26_9_signal", "momentum", ema("macd_12_26_9", 9, ema_12=1.0, ema_26=-1.0), ["Close"])
_add("macd_12_26_9_hist", "momentum", lambda d: "macd_12_26_9 - macd_12_26_9_signal", ["Close"])
_help("tp_avg_20", lambda d: d.full("avg", "tp", 20))
_help("tp_list_20", lambda d: d.window_list("tp", 20))
_help("tp_mad_20", lambda d: d.mean_abs_dev("tp_list_20", 20))
_add("cci_20", "momentum", lambda d: d.div("(tp - tp_avg_20)", "(0.015 * tp_mad_20)"), HLC, window=20)
_add("williams_r_14", "momentum", lambda d: "-100 * " + d.div("(high_14 - Close)", "(high_14 - low_14)"), HLC, window=14)
for p in (10, 20):
    _add(f"roc_{p}", "momentum", lambda d, p=p: "100 * " + d.div(f"(Close - {d.lag('Close', p)})", d.lag("Close", p)), ["Close"], periods=p)
    _add(f"momentum_{p}", "momentum", lambda d, p=p: f"Close - {d.lag('Close', p)}", ["Close"], periods=p)
_help("trix_1", ema("Close", 15))
_help("trix_2", ema("trix_1", 15))
_help("trix_3", ema("trix_2", 15))
_add("trix_15", "momentum", lambda d: "100 * (" + d.div("trix_3", d.lag("trix_3", 1)) + " - 1)", ["Close"], span=15)
_help("buying", lambda d: "Close - least(Low, prev_close)")
_add("ultimate_osc", "momentum", lambda d: "100 * (" + " + ".join(f"{m} * {d.div(d.full('sum', 'buying', w), d.full('sum', 'true_range', w))}" for m, w in ((4, 7), (2, 14), (1, 28))) + ") / 7", HLC)
_help("mid", lambda d: "(High + Low) / 2")
_add("awesome_osc", "momentum", lambda d: f"({d.full('avg', 'mid', 5)}) - ({d.full('avg', 'mid', 34)})", ["High", "Low"])
_add("ppo", "momentum", lambda d: "100 * " + d.div("(ema_12 - ema_26)", "ema_26"), ["Close"])
_help("rise", lambda d: "High - prev_high")
_help("fall", lambda d: "prev_low - Low")
_help("dm_plus", lambda d: "CASE WHEN rise > fall AND rise > 0 THEN rise ELSE 0.0 END")
_help("dm_minus", lambda d: "CASE WHEN fall > rise AND fall > 0 THEN fall ELSE 0.0 END")
for sign in ("plus", "minus"):
    _add(f"dmi_{sign}_14", "momentum", lambda d, s=sign: "100 * " + d.div(d.full("avg", f"dm_{s}", 14), "atr_h_14"), HLC, window=14)
_help("dx_14", lambda d: "100 * " + d.div("abs(dmi_plus_14 - dmi_minus_14)", "(dmi_plus_14 + dmi_minus_14)"))
_add("adx_14", "momentum", lambda d: d.full("avg", "dx_14", 14), HLC, window=14)
_help("high_list_26", lambda d: d.window_list("High", 26))
_help("low_list_26", lambda d: d.window_list("Low", 26))
_add("aroon_up_25", "momentum", lambda d: f"CAST({d.place('high_list_26', 'max')} AS DOUBLE) * 4", ["High"], window=25)
_add("aroon_down_25", "momentum", lambda d: f"CAST({d.place('low_list_26', 'min')} AS DOUBLE) * 4", ["Low"], window=25)
_add("aroon_osc_25", "momentum", lambda d: "aroon_up_25 - aroon_down_25", ["High", "Low"], window=25)
_help("vm_plus", lambda d: "abs(High - prev_low)")
_help("vm_minus", lambda d: "abs(Low - prev_high)")
for sign in ("plus", "minus"):
    _add(f"vortex_{sign}_14", "momentum", lambda d, s=sign: d.div(d.full("sum", f"vm_{s}", 14), d.full("sum", "true_range", 14)), HLC, window=14)
for p in (10, 15, 20, 30):
    _help(f"kst_roc_{p}", lambda d, p=p: "100 * " + d.div(f"(Close - {d.lag('Close', p)})", d.lag("Close", p)))
_add("kst", "momentum", lambda d: " + ".join(f"{m} * ({d.full('avg', f'kst_roc_{p}', w)})" for m, p, w in ((1, 10, 10), (2, 15, 10), (3, 20, 10), (4, 30, 15))), ["Close"])
_help("tsi_up_1", ema("diff", 25))
_help("tsi_up_2", ema("tsi_up_1", 13))
_help("tsi_all_1", ema("abs_diff", 25))
_help("tsi_all_2", ema("tsi_all_1", 13))
_add("tsi_25_13", "momentum", lambda d: "100 * " + d.div("tsi_up_2", "tsi_all_2"), ["Close"])
_help("fisher_v", lambda d: "2 * (" + d.div("(mid - low_10)", "(high_10 - low_10)") + " - 0.5)")
_help("fisher_c", lambda d: "CASE WHEN fisher_v IS NOT NULL THEN greatest(least(fisher_v, 0.999), -0.999) END")
_add("fisher_transform_10", "momentum", lambda d: "0.5 * ln((1 + fisher_c) / (1 - fisher_c))", ["High", "Low"], window=10)
_help("ema_13", ema("Close", 13))
_add("elder_ray_bull_13", "momentum", lambda d: "High - ema_13", ["High", "Close"])
_add("elder_ray_bear_13", "momentum", lambda d: "Low - ema_13", ["Low", "Close"])

# volume
HLCV = ["High", "Low", "Close", "Volume"]
_help("signed_volume", lambda d: "coalesce(sign(diff), 0) * Volume")
_add("obv", "volume", Running("signed_volume"), ["Close", "Volume"])
_help("money_flow", lambda d: "coalesce(" + d.div("((Close - Low) - (High - Close))", "(High - Low)") + ", 0) * Volume")
_add("ad_line", "volume", Running("money_flow"), HLCV)
_add("cmf_20", "volume", lambda d: d.div(d.full("sum", "money_flow", 20), d.full("sum", "Volume", 20)), HLCV, window=20)
_help("flow_up", lambda d: "CASE WHEN tp > tp_prev THEN tp_volume ELSE 0.0 END")
_help("flow_down", lambda d: "CASE WHEN tp < tp_prev THEN tp_volume ELSE 0.0 END")
_add("mfi_14", "volume", lambda d: f"100 - {d.div('100', '(1 + ' + d.div(d.full('sum', 'flow_up', 14), d.full('sum', 'flow_down', 14)) + ')')}", HLCV, window=14)
_help("force", lambda d: "diff * Volume")
_add("force_index_13", "volume", ema("force", 13), ["Close", "Volume"], span=13)
_help("mid_prev", lambda d: d.lag("mid", 1))
_help("eom_1", lambda d: d.div("(mid - mid_prev)", d.div(d.div("Volume", "(High - Low)"), "100000000.0")))
_add("eom_14", "volume", lambda d: d.full("avg", "eom_1", 14), ["High", "Low", "Volume"], window=14)
_add("volume_roc_10", "volume", lambda d: "100 * " + d.div(f"(Volume - {d.lag('Volume', 10)})", d.lag("Volume", 10)), ["Volume"])
_help("ret_volume", lambda d: "coalesce(ret * Volume, 0)")
_add("pvt", "volume", Running("ret_volume"), ["Close", "Volume"])
_help("kvo_volume", lambda d: "CASE WHEN tp > tp_prev THEN Volume ELSE -Volume END")
_help("kvo_34", ema("kvo_volume", 34))
_help("kvo_55", ema("kvo_volume", 55))
_add("kvo_34_55", "volume", lambda d: "kvo_34 - kvo_55", HLCV)
_add("vwap_proxy_20", "volume", lambda d: "vwma_20", HLCV, window=20)
_help("volume_avg_20", lambda d: d.full("avg", "Volume", 20))
_help("volume_std_20", lambda d: d.full("stddev_samp", "Volume", 20))
_add("volume_zscore_20", "volume", lambda d: d.div("(Volume - volume_avg_20)", "volume_std_20"), ["Volume"], window=20)
_add("volume_spike_20", "volume", lambda d: d.flag("Volume > volume_avg_20 + 2 * volume_std_20"), ["Volume"], window=20)

# candle
OHLC = ["Open", "High", "Low", "Close"]
_add("candle_body", "candle", lambda d: "Close - Open", ["Open", "Close"])
_add("upper_wick", "candle", lambda d: "High - greatest(Close, Open)", OHLC)
_add("lower_wick", "candle", lambda d: "least(Close, Open) - Low", OHLC)
_add("body_to_range_ratio", "candle", lambda d: d.div("abs(Close - Open)", "(High - Low)"), OHLC)
_add("close_pos_in_range", "candle", lambda d: d.div("(Close - Low)", "(High - Low)"), HLC)
_add("breakout_20", "candle", lambda d: d.flag(f"Close > ({d.full('max', 'High', 20, 1)})"), ["High", "Close"], window=20)
_add("breakdown_20", "candle", lambda d: d.flag(f"Close < ({d.full('min', 'Low', 20, 1)})"), ["Low", "Close"], window=20)
_add("inside_bar", "candle", lambda d: d.flag("High < prev_high AND Low > prev_low"), ["High", "Low"])
_help("body_abs", lambda d: "abs(Close - Open)")
_help("body_prev", lambda d: d.lag("body_abs", 1))
_add("engulfing_proxy", "candle", lambda d: d.flag("body_abs > 1.5 * body_prev"), ["Open", "Close"])


# regime
_KS = tuple(range(2, 20))
for k in _KS:
    _help(f"hurst_d_{k}", lambda d, k=k: f"Close - {d.lag('Close', k)}")
    _help(f"hurst_t_{k}", lambda d, k=k: d.ln(f"({d.full('stddev_pop', f'hurst_d_{k}', 100 - k)})"))


def _hurst(d: Spark) -> str:
    """Least-squares slope of ln tau on ln k; null where any tau is 0."""
    logs = [math.log(k) for k in _KS]
    mean = sum(logs) / len(logs)
    var = sum((x - mean) ** 2 for x in logs)
    return "(" + " + ".join(f"{x - mean!r} * hurst_t_{k}" for x, k in zip(logs, _KS)) + f") / {var!r}"


_add("hurst_100", "regime", _hurst, ["Close"], window=100)
_help("ret_prev", lambda d: d.lag("ret", 1))
_help("ret_n_50", lambda d: d.frame("count(ret)", 49))


def _autocorr(d: Spark) -> str:
    """Correlation of a window's returns with the returns one row before, inside the window."""
    f = lambda call: d.frame(call, 48)
    return f"CASE WHEN ret_n_50 = 50 THEN {d.div(f('covar_samp(ret, ret_prev)'), '(' + f('stddev_samp(ret)') + ' * ' + f('stddev_samp(ret_prev)') + ')')} END"


_add("autocorr_return_1_50", "regime", _autocorr, ["Close"], window=50)
_add("skew_return_20", "regime", lambda d: d.skew("ret", 20), ["Close"], window=20)
_add("kurt_return_20", "regime", lambda d: d.kurt("ret", 20), ["Close"], window=20)
_help("close_max_20", lambda d: d.full("max", "Close", 20))
_help("close_min_20", lambda d: d.full("min", "Close", 20))
_add("rolling_drawdown_20", "regime", lambda d: d.div("(Close - close_max_20)", "close_max_20"), ["Close"], window=20)
_add("dist_to_rolling_max_20", "regime", lambda d: d.div("(Close - close_max_20)", "Close"), ["Close"], window=20)
_add("dist_to_rolling_min_20", "regime", lambda d: d.div("(Close - close_min_20)", "Close"), ["Close"], window=20)
_help("ret_list_20", lambda d: d.window_list("ret", 20))
_add("entropy_proxy_20", "regime", lambda d: d.entropy("ret_list_20", 10, 20), ["Close"], window=20)
_help("ret_avg_20", lambda d: d.full("avg", "ret", 20))
_add("change_point_score_20", "regime", lambda d: d.flag("abs(" + d.div("(ret - ret_avg_20)", "ret_std_20") + ") > 2"), ["Close"], window=20)


def compute(candles: DataFrame, names: Iterable[str], shift: bool = True, registry: Registry = REGISTRY, stretch: int | None = None) -> DataFrame:
    """candles with a column per name, each (with shift) as of the row before.

    Series are the rows of one Ticker by Datetime.  Rows of a series too short
    for a window get null, flags 0 (null in the first row once shifted).
    With stretch, or where a series is too long for one task, windows are
    computed over stretches of that many rows with what they look back at.
    """
    names, length = list(names), stretch or automatic(candles)
    d = Stretched() if length else Spark()
    out = numbered(candles, length) if length else candles
    todo = [n for level in registry.levels(names, d) for n in level]
    is_barrier = lambda n: isinstance(registry.formula(n), (Recurrence, Running) if length else Recurrence)
    lag = lambda n: F.expr(d.lag(n, 1)).alias(n) if shift else F.col(n)

    def selected(out: DataFrame, levels: list[list[str]], last: bool) -> DataFrame:
        """All windows of these levels, and the shift behind the last ones."""
        if length:
            own = ["__row", "__own", "__stretch"]
            behind = sum(max(registry.reach(n, d) for n in level) for level in levels) + last
            out = haloed(out, max(length, behind), behind)
        for level in levels:
            out = out.select("*", *[F.expr(registry.texts(n, d)[0]).alias(n) for n in level])
        if last:
            out = out.select(*candles.columns, *(own if length else []), *map(lag, names))
        return out.where("__own").drop("__own", "__stretch") if length else out

    levels: list[list[str]] = []
    while todo:
        # All formulas that need no recurrence still to come, level by level; then all recurrences that these and each other feed.
        while plain := [n for n in todo if not is_barrier(n) and not registry.needs(n, d).intersection(todo)]:
            levels.append(plain)
            todo = [n for n in todo if n not in plain]
        if not todo:
            break
        out, levels = selected(out, levels, False) if levels else out, []
        means = [n for n in todo if isinstance(registry.formula(n), Recurrence)]
        sums = [n for n in todo if is_barrier(n) and n not in means and not registry.needs(n, d).intersection(todo)]

        def waits(n: str) -> bool:
            f = registry.formula(n)
            return bool({x for x, _ in f.of} & (set(todo) - set(means)) if f.of else registry.needs(n, d).intersection(todo))

        while late := [n for n in means if waits(n)]:
            means = [n for n in means if n not in late]
        if sums:
            out = running_sums(out, {n: registry.formula(n).of for n in sums}, length)
        if means:
            out = linear_recurrences(out, [registry.formula(n).part(n, d) for n in means])
        todo = [n for n in todo if n not in means and n not in sums]
    return selected(out, levels, True).select(*candles.columns, *names)


def compute_sql(source: str, names: Iterable[str], dialect: Spark, shift: bool = True, registry: Registry = REGISTRY) -> str:
    """The same as one query in another dialect, over a candle query."""
    names = list(names)
    text = source
    for level in registry.levels(names, dialect):
        parts = {n: registry.texts(n, dialect) for n in level}
        maps = {n: p for n, p in parts.items() if len(p) == 2}
        if maps:  # the maps' own windows first
            text = f"SELECT *, {', '.join(f'{a} AS {n}__a, {b} AS {n}__b' for n, (a, b) in maps.items())} FROM ({text})"
        cols = [(p[0] if n not in maps else dialect.recurrence(f"{n}__a", f"{n}__b")) + f" AS {n}" for n, p in parts.items()]
        text = f"SELECT *, {', '.join(cols)} FROM ({text})"
    last = [(dialect.lag(n, 1) if shift else n) + f" AS {n}" for n in names]
    return f"SELECT Ticker, Datetime, {', '.join(last)} FROM ({text})"


def indicator_features(candles: DataFrame, groups: list[str], prune=None, registry: Registry = REGISTRY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candles with the indicators of some groups, pruning decisions, first-row leak report).

    With prune (a Pruner) constant, gappy and twin columns of the whole frame
    go first; fit it on training rows by itself where a model follows.
    """
    from tallow.operators.features import first_row_gaps

    names = [n for g in groups for n in registry.by_category(g)]
    out = compute(candles, names, registry=registry)
    spark = candles.sparkSession
    decisions = spark.createDataFrame([], "column string, reason string, detail string")
    if prune is not None:
        out = scratch.table(out, "indicators")
        prune.fit(out, names)
        decisions, out = prune.summary(spark), prune.transform(out)
    return out, decisions, first_row_gaps(out, [n for n in names if n in out.columns])


def leak_audit(candles: DataFrame, names: Iterable[str], factor: float = 10.0, registry: Registry = REGISTRY) -> DataFrame:
    """(name, moved): in how many series an indicator changes in the very row whose close is multiplied, the middle one; it should be none."""
    names = list(names)
    whole = Window.partitionBy("Ticker")
    placed = candles.withColumn("__hit", F.row_number().over(whole.orderBy("Datetime")) == F.floor(F.count("*").over(whole) / 2) + 1)
    placed = scratch.table(placed, "audit")
    changed = placed.withColumn("Close", F.when(F.col("__hit"), F.col("Close") * factor).otherwise(F.col("Close")))
    keep = lambda df, tag: compute(df, names, registry=registry).where("__hit").select("Ticker", F.array(*[F.col(n).cast("double") for n in names]).alias(tag))
    both = keep(placed, "a").join(keep(changed, "b").hint("merge"), "Ticker")
    off = lambda a, b: (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > 1e-5 * F.greatest(F.abs(a), F.abs(b)), F.lit(False))
    each = both.select(F.explode(F.zip_with(F.arrays_zip("a", "b"), F.array(*map(F.lit, names)), lambda x, n: F.struct(n.alias("name"), off(x["a"], x["b"]).cast("long").alias("m")))).alias("z"))
    return each.groupBy(F.col("z.name").alias("name")).agg(F.sum("z.m").alias("moved"))
