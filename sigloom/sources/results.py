"""Result tables and texts."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sigloom.operators.features import exposed, histogram, label, parsed


def write_table(df: DataFrame, path: str) -> None:
    """Replace a table; Spark writes aside and commits at the end, so readers never see half of it."""
    df.write.mode("overwrite").parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else the context's own, else (on one machine) a new one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """A result, computed once and kept as a table in the shared folder, so that plans built on it stay small; it goes with the session."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/study-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def append_batches(make, draws: list, path: str, every: int = 50) -> None:
    """Write a search log in batches of ``every`` trials: ``make`` turns some draws into rows."""
    if not draws or every < 1:
        raise ValueError("there must be draws, and at least one to a batch")
    for at in range(0, len(draws), every):
        make(draws[at : at + every]).write.mode("append" if at else "overwrite").parquet(path)


DATASETS = {"combined": "trajectory_combined.parquet", "random": "trajectory.parquet", "bayesian": "trajectory_bayesian.parquet"}  # fixed names


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def available(spark: SparkSession, folder: str) -> dict[str, str]:
    """The search logs that are there, by name."""
    return {name: f"{folder}/{file}" for name, file in DATASETS.items() if _exists(spark, f"{folder}/{file}")}


def read_trajectory(spark: SparkSession, folder: str, dataset: str | None = None) -> DataFrame:
    """A search log with its expressions' fields as columns: the one asked for, else the combined one, else the random one."""
    there = available(spark, folder)
    name = dataset or ("combined" if "combined" in there else "random")
    if name not in there:
        raise FileNotFoundError(f"no log {name!r} in {folder}; there are {sorted(there)}")
    return exposed(spark.read.parquet(there[name]))


def write_text(text: str, path: str) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    partial = target.with_suffix(target.suffix + ".tmp")
    partial.write_text(text, encoding="utf-8")
    partial.replace(target)


def _n(x: float | None, form: str = ".3f") -> str:
    return "n/a" if x is None else format(x, form)


def report(summary: list[Row], audited: DataFrame, panel: Row, purity: float, nmi: float, distance_all: float, distance_top: float) -> str:
    """Markdown of a finished study from collected aggregates (a row an optimizer); every statement follows from the numbers."""
    lines = ["# Signal study", "", f"{panel.n_tickers} tickers over {panel.n_dates} dates, {panel.start_date} to {panel.end_date}.", "", "## Search", ""]
    lines += [f"- **{r['optimizer'].title()}:** {r['count']} evaluations; mean Sharpe {_n(r['mean'])}, median {_n(r['median'])}, best {_n(r['max'])}." for r in summary]
    lines += ["", "## Landscape", "", f"Clusters match families with purity {_n(purity)} and mutual information {_n(nmi)}. Mean distance of all pairs {_n(distance_all)}, of the best tenth {_n(distance_top)}."]
    lines += ["", "## Holdout", "", "| Optimizer | Expression | Selected at | Gross | Net | Probability | 95% interval |", "|---|---|---:|---:|---:|---:|---:|"]
    rows = parsed(audited).withColumn("label", label(F.col("e"))).collect()
    for r in rows:
        lines.append(
            f"| {r.optimizer.title()} | {r.label} | {_n(r.selection_sharpe)} | {_n(r.test_sharpe)} | {_n(r.test_net_sharpe)} | {_n(r.test_probabilistic_sharpe_ratio, '.1%')} | [{_n(r.test_sharpe_ci_lower)}, {_n(r.test_sharpe_ci_upper)}] |"
        )
    wide = [r for r in rows if r.test_sharpe_ci_lower is not None and r.test_sharpe_ci_lower > 0]
    lines += ["", "No interval excludes zero." if not wide else f"{len(wide)} of {len(rows)} intervals lie above zero.", ""]
    return "\n".join(lines)


def forward_summary(results: list[Row]) -> str:
    """Markdown of a forward test."""
    lines = ["# Forward test", "", "Frozen expressions on dates after the study's last one. Nothing is selected or tuned here.", ""]
    lines += ["| Expression | Chosen by | Window | Obs. | Gross | Net | 95% interval |", "|---|---|---|---:|---:|---:|---:|"]
    for r in results:
        lines.append(
            f"| {r.expression} | {r.selected_by} | {r.forward_start} to {r.forward_end} | {r.forward_n_observations} | {_n(r.forward_sharpe)} | {_n(r.forward_net_sharpe)} | [{_n(r.forward_sharpe_ci_lower)}, {_n(r.forward_sharpe_ci_upper)}] |"
        )
    return "\n".join([*lines, "", "**Power:**", "", *(f"- {r.power_verdict}" for r in results), ""])


def figures(trials: DataFrame, distances: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """The data behind the figures; drawing them is left to the reader's tool."""
    return {"distance_histogram": histogram(distances, "distance", 30), "sharpe_histogram": histogram(trials, "sharpe", 20), "points": labels}
