"""Temperature scaling, reliability and conformal prediction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.arrays import nll_term, probability_of, softmax, to_matrix
from sievemark.operators.metrics import right_closed_bin
from sievemark.operators.ordered import value_at_rank


def nll(df: DataFrame, logits: str, y: str, temperature: float = 1.0) -> DataFrame:
    return df.agg(F.avg(nll_term(softmax(logits, temperature), y)).alias("nll"))


def nll_grid(df: DataFrame, logits: str, y: str, temperatures: Sequence[float]) -> DataFrame:
    """Mean NLL at every temperature from one pass: each Arrow batch returns one partial sum each."""
    grid = np.asarray(temperatures, dtype=np.float64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(grid)), 0
        for batch in batches:
            z, present = to_matrix(batch.column(0))
            if not len(z):
                continue
            label = batch.column(1).to_numpy(zero_copy_only=False)[present].astype(int)
            z = z - z.max(axis=1, keepdims=True)
            n += len(z)
            for i, t in enumerate(grid):
                e = np.exp(z / t)
                sums[i] -= np.log(e[np.arange(len(z)), label] / e.sum(axis=1) + 1e-12).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(grid), pa.array(sums), pa.array(np.full(len(grid), n))], ["temperature", "s", "n"]
        )

    parts = df.select(logits, y).mapInArrow(partial, "temperature double, s double, n long")
    return parts.groupBy("temperature").agg((F.sum("s") / F.sum("n")).alias("nll"))


def fit_temperature(df: DataFrame, logits: str, y: str, rounds: int = 3, points: int = 64) -> float:
    """Minimiser of the NLL over log T in [ln .05, ln 20] (NLL is convex in 1/T): a refined grid."""
    low, high = np.log(0.05), np.log(20.0)
    best = 0.0
    for _ in range(rounds):
        grid = np.linspace(low, high, points)
        rows = nll_grid(df, logits, y, np.exp(grid).tolist()).collect()  # `points` rows
        score = {round(float(np.log(r["temperature"])), 9): r["nll"] for r in rows}
        i = int(np.argmin([score[round(float(g), 9)] for g in grid]))
        best, low, high = grid[i], grid[max(i - 1, 0)], grid[min(i + 1, points - 1)]
    return float(np.exp(best))


def reliability(df: DataFrame, conf: str, correct: str, bins: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """Non-empty right-closed equal bins: mean confidence, accuracy, count."""
    edges = [i / bins for i in range(1, bins)]
    index = F.lit(0)
    for e in edges:
        index = index + (F.col(conf) > e).cast("int")
    return df.groupBy(*by, index.alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg(conf).alias("confidence"),
        F.avg(F.col(correct).cast("double")).alias("accuracy"),
    )


def reliability_at(df: DataFrame, conf: str, correct: str, edges: Sequence[float], include_lowest: bool = False) -> DataFrame:
    """Reliability over a custom edge list; empty bins and values outside the edges are dropped."""
    index = right_closed_bin(F.col(conf), edges, include_lowest)
    return (
        df.groupBy(index.alias("bin"))
        .agg(
            F.avg(conf).alias("confidence"),
            F.avg(F.col(correct).cast("double")).alias("accuracy"),
            F.count("*").alias("n"),
        )
        .where("bin is not null")
    )


def ece(df: DataFrame, conf: str, correct: str, bins: int = 15, by: Sequence[str] = ()) -> DataFrame:
    table = reliability(df, conf, correct, bins, by)
    gap = F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")
    return table.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def conformal_rank(total: Column, alpha: float) -> Column:
    """0-based index of the "higher" quantile at level min(1, ceil((n + 1)(1 - α)) / n)."""
    level = F.least(F.lit(1.0), F.ceil((total + 1) * F.lit(1 - alpha)) / total)
    return F.ceil(level * (total - 1))


def qhat(df: DataFrame, probs: str, y: str, alpha: float = 0.1) -> DataFrame:
    """Conformal threshold: an exact order statistic of 1 - p(true) over all rows."""
    scores = df.select((1 - probability_of(probs, y)).alias("score"))
    return value_at_rank(scores, "score", lambda total: conformal_rank(total, alpha), name="qhat")


def set_metrics(df: DataFrame, members: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Coverage, mean size and singleton rate of prediction sets."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.array_contains(members, F.col(y)).cast("double")).alias("coverage"),
        F.avg(F.size(members).cast("double")).alias("mean_size"),
        F.avg((F.size(members) == 1).cast("double")).alias("singleton_rate"),
    )
