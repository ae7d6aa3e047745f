"""Statistics that Spark has no function for."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

EULER_GAMMA = 0.5772156649015329
_NORMAL = NormalDist()


def _cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else _NORMAL.cdf(x)).astype("float64")


def normal_cdf(z: str | Column) -> Column:
    """Standard normal distribution function; null for null."""
    return F.nanvl(pandas_udf(_cdf, DoubleType())(z), F.lit(None).cast("double"))


def skewness(c: str) -> Column:
    """Bias-corrected; null below 3 values, 0 without deviation."""
    n, g = F.count(c).cast("double"), F.skewness(c)
    return F.when(F.count(c) >= 3, F.when(F.stddev_pop(c) > 0, g * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0))


def kurtosis(c: str) -> Column:
    """Bias-corrected, 3 for a normal distribution; null below 4 values."""
    n, g = F.count(c).cast("double"), F.kurtosis(c)
    excess = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6)
    return F.when(F.count(c) >= 4, F.when(F.stddev_pop(c) > 0, excess).otherwise(0.0) + 3)


def psr_z(sharpe: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """z-score of the probabilistic Sharpe ratio, of Sharpe ratios a period; null where it isn't defined."""
    variance = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe
    finite = lambda c: c.isNotNull() & (F.abs(c) < float("inf"))
    known = (n >= 2) & finite(sharpe) & finite(benchmark) & finite(skew) & finite(kurt) & (variance > 0)
    return F.when(known, (sharpe - benchmark) * F.sqrt(n - 1) / F.sqrt(variance))


def probabilistic_sharpe(sharpe: float, benchmark: float, n: int, skew: float, kurt: float) -> float:
    """The same for plain numbers, as a probability."""
    variance = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2
    if n < 2 or not all(map(math.isfinite, (sharpe, benchmark, skew, kurt))) or variance <= 0:
        return math.nan
    return _NORMAL.cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(variance))


def maximum_factor(n: int) -> float:
    """Expected maximum of ``n`` standard normal trials, approximately."""
    return (1 - EULER_GAMMA) * _NORMAL.inv_cdf(1 - 1 / n) + EULER_GAMMA * _NORMAL.inv_cdf(1 - 1 / (n * math.e))


def _factors(n: pd.Series) -> pd.Series:
    return n.map(lambda k: maximum_factor(int(k)) if k >= 2 else 0.0).astype("float64")


def expected_max_sharpe(trials: DataFrame, column: str = "sharpe", by: str = "optimizer") -> DataFrame:
    """``by``, n_trials, expected_max: what the best of so many noisy trials is expected to reach; 0 with fewer than two."""
    finite = F.when(F.abs(column) < float("inf"), F.col(column))
    told = trials.groupBy(by).agg(F.count(finite).alias("n_trials"), F.avg(finite).alias("mean"), F.stddev_samp(finite).alias("sd"))
    best = F.when((F.col("n_trials") >= 2) & (F.col("sd") > 0), F.col("mean") + F.col("sd") * pandas_udf(_factors, DoubleType())("n_trials")).otherwise(0.0)
    return told.select(by, "n_trials", best.alias("expected_max"))


def bootstrap_interval(values: np.ndarray, horizon: int, confidence: float = 0.95, replicates: int = 2000, block: int | None = None, seed: int = 42) -> tuple[float, float]:
    """Circular moving-block bootstrap of the annualized Sharpe ratio.

    Starts come from one generator, a replicate's at a time, so a seed gives the same interval everywhere.
    """
    if horizon < 1 or replicates < 1 or not 0 < confidence < 1:
        raise ValueError("horizon and replicates must be positive, confidence between 0 and 1")
    x = np.asarray(values, float)
    x, n = x[~np.isnan(x)], int((~np.isnan(np.asarray(values, float))).sum())
    if n < 2:
        return math.nan, math.nan
    size = block or max(horizon, round(n ** (1 / 3)))
    if size < 1:
        raise ValueError("block must be positive")
    rng, blocks = np.random.default_rng(seed), -(-n // size)
    starts = np.stack([rng.integers(0, n, size=blocks) for _ in range(replicates)])
    found = np.full(replicates, np.nan)
    for at in range(0, replicates, 250):  # some replicates at a time bound the memory
        rows = x[((starts[at : at + 250, :, None] + np.arange(size)) % n).reshape(-1, blocks * size)[:, :n]]
        sd = rows.std(axis=1, ddof=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            found[at : at + 250] = np.where(sd > 0, rows.mean(axis=1) / sd * math.sqrt(252 / horizon), np.nan)
    low, high = np.nanquantile(found, [(1 - confidence) / 2, (1 + confidence) / 2])
    return float(low), float(high)


def bootstrap_ci(days: DataFrame, horizon: int, by: str = "expr_id", seed: int = 42, replicates: int = 2000) -> DataFrame:
    """``by``, ci_lower, ci_upper: a bootstrap a group, groups in parallel; a group is one history of returns."""
    kind = dict(days.dtypes)[by]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap_interval(pdf.sort_values("d_idx")["port_ret"].to_numpy(float), horizon, seed=seed, replicates=replicates)
        return pd.DataFrame({by: [key[0]], "ci_lower": [low], "ci_upper": [high]})

    return days.select(by, "d_idx", "port_ret").groupBy(by).applyInPandas(run, f"{by} {kind}, ci_lower double, ci_upper double")
