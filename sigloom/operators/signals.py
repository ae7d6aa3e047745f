"""The expression grammar and its rolling-window signals.

All windows of a panel run over one sort by ticker and row: the series of all
lookbacks are columns of a single select, from which expressions are unfolded.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the grammar.
LOOKBACKS = (5, 10, 20, 40, 60, 120, 180, 252)
SHORTS = (5, 10, 20, 40)
LONGS = (40, 60, 120, 180, 252)
NORMALIZERS = tuple(n for n in LOOKBACKS if n <= 120)
FAMILIES = ("momentum", "mean_reversion", "volatility", "volume_ratio", "ma_crossover")
#: Digits that signals are rounded to before they are ranked: sums of one frame in different order differ by less.
DIGITS = 10


@dataclass(frozen=True)
class Expression:
    """A signal: a family, its lookback (or short and long one), and perhaps a volatility to divide by."""

    primitive: str
    lookback: int | None = None
    short: int | None = None
    long: int | None = None
    normalize_lookback: int | None = None

    def __post_init__(self) -> None:
        if self.primitive not in FAMILIES:
            raise ValueError(f"unknown primitive {self.primitive!r}")
        if self.primitive == "ma_crossover":
            if not (self.short and self.long and 0 < self.short < self.long):
                raise ValueError("ma_crossover needs 0 < short < long")
        elif not self.lookback or self.lookback < 1:
            raise ValueError("lookback must be at least 1")
        if self.normalize_lookback is not None and self.normalize_lookback < 1:
            raise ValueError("normalize_lookback must be at least 1")

    def fields(self) -> dict:
        own = {k: getattr(self, k) for k in ("lookback", "short", "long") if getattr(self, k) is not None}
        own |= {"primitive": self.primitive, "normalize_by": "volatility" if self.normalize_lookback else None}
        return own | ({"normalize_lookback": self.normalize_lookback} if self.normalize_lookback else {})

    def json(self) -> str:
        """The canonical text, keys sorted; the key for duplicates."""
        return json.dumps(self.fields(), sort_keys=True)

    @staticmethod
    def of(value: str | dict) -> Expression:
        raw = json.loads(value) if isinstance(value, str) else dict(value)
        if not isinstance(raw, dict):
            raise ValueError("an expression is a JSON object")
        if raw.get("normalize_by") not in (None, "none", "volatility"):
            raise ValueError(f"unknown normalizer {raw['normalize_by']!r}")
        lookback = raw.get("normalize_lookback") if raw.get("normalize_by") == "volatility" else None
        return Expression(raw.get("primitive"), raw.get("lookback"), raw.get("short"), raw.get("long"), lookback)


def grammar() -> list[Expression]:
    """All 351 expressions, in a fixed order."""
    out = []
    for family in FAMILIES[:-1]:
        for n in LOOKBACKS:
            out += [Expression(family, n, normalize_lookback=m) for m in (None, *NORMALIZERS) if not (family == "volatility" and m == n)]
    return out + [Expression("ma_crossover", None, s, n, m) for s in SHORTS for n in LONGS if s < n for m in (None, *NORMALIZERS)]


def _frame(n: int):
    if n < 1:
        raise ValueError("lookback must be at least 1")
    return Window.partitionBy("ticker").orderBy("d_idx").rowsBetween(1 - n, 0)


def _full(value: str, n: int, result: Column) -> Column:
    """``result`` where the whole frame is there."""
    return F.when(F.count(value).over(_frame(n)) == n, result)


def momentum(n: int) -> Column:
    return _full("ret", n, F.product(1 + F.col("ret")).over(_frame(n)) - 1)


def mean_reversion(n: int) -> Column:
    return F.col("price") - _full("price", n, F.avg("price").over(_frame(n)))


def volatility(n: int) -> Column:
    return _full("ret", n, F.stddev_samp("ret").over(_frame(n)))


def volume_ratio(n: int) -> Column:
    return F.try_divide("volume", _full("volume", n, F.avg("volume").over(_frame(n))))


def with_ewm(panel: DataFrame, spans: tuple[int, ...]) -> DataFrame:
    """Adds ``ewm_<span>``, the recursive average of prices, to a panel.

    A recurrence has no window form that is linear in the rows.  It runs as one
    pass a ticker in pandas, over three narrow columns; a ticker has as many rows as there are dates.
    """
    names = [f"ewm_{s}" for s in spans]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d_idx")
        for s in spans:
            pdf[f"ewm_{s}"] = pdf["price"].astype(float).ewm(span=s, adjust=False, min_periods=s).mean()
        return pdf[["d_idx", "ticker", *names]]

    schema = "d_idx int, ticker string, " + ", ".join(f"{n} double" for n in names)
    own = panel.select("d_idx", "ticker", "price").groupBy("ticker").applyInPandas(run, schema)
    return panel.join(own.select("d_idx", "ticker", *(F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names)), ["d_idx", "ticker"])


def ma_crossover(short: int, long: int) -> Column:
    """Needs the columns of ``with_ewm``."""
    if not 0 < short < long:
        raise ValueError("short must be shorter than long")
    return F.col(f"ewm_{short}") - _full("price", long, F.avg("price").over(_frame(long)))


def _series(e: Expression) -> tuple[Column, Column | None]:
    """The window of an expression before it is normalized, and what it is divided by."""
    if e.primitive == "ma_crossover":
        own = ma_crossover(e.short, e.long)
    else:
        own = {"momentum": momentum, "mean_reversion": mean_reversion, "volatility": volatility, "volume_ratio": volume_ratio}[e.primitive](e.lookback)
    return own, volatility(e.normalize_lookback) if e.normalize_lookback else None


def signals(panel: DataFrame, expressions: list[Expression], horizon: int | None = None) -> DataFrame:
    """expr_id, d_idx, ticker, signal for all cells; expr_id is the place in the list.

    Each rolling series is a column of its own, computed once whatever the
    number of expressions made of it; the expressions are then unfolded from
    one row of series, so their number multiplies rows, never windows.  With a
    ``horizon`` the cell's forward return comes along as ``fwd``.
    """
    spans = tuple(sorted({e.short for e in expressions if e.primitive == "ma_crossover"}))
    wide = with_ewm(panel, spans) if spans else panel
    series: dict[tuple, Column] = {}

    def place(key: tuple, column: Column) -> int:
        series.setdefault(key, column)
        return list(series).index(key) + 1

    told = []
    for k, e in enumerate(expressions):
        own, by = _series(e)
        told.append((k, place((e.primitive, e.lookback, e.short, e.long), own), place(("volatility", e.normalize_lookback, None, None), by) if by is not None else 0))
    extra = [forward(horizon).alias("fwd")] if horizon else []
    cells = wide.select("d_idx", "ticker", *extra, *(c.alias(f"s{k}") for k, c in enumerate(series.values())))
    columns = F.array(*(F.col(f"s{k}") for k in range(len(series)))).alias("x")
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("expr_id"), F.lit(a).alias("own"), F.lit(b).alias("by")) for k, a, b in told))).alias("e")
    names = ["d_idx", "ticker", *(["fwd"] if horizon else [])]
    rows = cells.select(*names, columns).select(*names, "x", asked)
    own = F.element_at("x", F.col("e.own"))
    value = F.when(F.col("e.by") > 0, F.try_divide(own, F.element_at("x", F.greatest(F.col("e.by"), F.lit(1))))).otherwise(own)
    finite = F.when(F.abs(value) < F.lit(float("inf")), value)
    return rows.select("e.expr_id", "d_idx", "ticker", F.round(finite, DIGITS).alias("signal"), *names[2:])


def forward(horizon: int) -> Column:
    """The return compounded over this row and the ``horizon - 1`` after it."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    ahead = Window.partitionBy("ticker").orderBy("d_idx").rowsBetween(0, horizon - 1)
    return F.when(F.count("ret").over(ahead) == horizon, F.product(1 + F.col("ret")).over(ahead) - 1)


def forward_returns(panel: DataFrame, horizon: int) -> DataFrame:
    """d_idx, ticker, fwd; see ``forward``."""
    return panel.select("d_idx", "ticker", forward(horizon).alias("fwd"))


def sample_expression(rng: np.random.Generator) -> Expression:
    """A random expression; the order of draws is fixed, so a seed gives the same sequence everywhere."""
    family = str(rng.choice(FAMILIES))
    lookback = short = long = None
    if family == "ma_crossover":
        short = int(rng.choice(SHORTS))
        long = int(rng.choice([n for n in LONGS if n > short]))
    else:
        lookback = int(rng.choice(LOOKBACKS))
    by = None
    if rng.integers(0, 2):
        by = int(rng.choice([n for n in NORMALIZERS if not (family == "volatility" and n == lookback)]))
    return Expression(family, lookback, short, long, by)
