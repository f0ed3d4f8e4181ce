"""Column scalers whose parameters come from one aggregate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainsight.session import Scratch


def robust_parameters(on: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range of each column; a range of 0 counts as 1. Columns without a value are left out."""
    q = on.agg(*[F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(n) for n in names]).first()
    return {n: (q[n][1], (q[n][2] - q[n][0]) or 1.0) for n in names if q[n] is not None}


def robust_scaled(df: DataFrame, names: list[str], on: DataFrame | None = None) -> DataFrame:
    """(x - median) / interquartile range; a range of 0 divides by 1, so sparse flags keep their values.

    The parameters come from ``on``, where given.
    """
    q = robust_parameters(df if on is None else on, names)
    return df.withColumns({n: (F.col(n) - q[n][0]) / q[n][1] if n in q else F.lit(None).cast("double") for n in names})


def yeo_johnson(x: Column, lam: Column | float) -> Column:
    """The transform as a column; ``lam`` may vary by row."""
    lam = F.lit(lam) if isinstance(lam, (int, float)) else lam
    two = 2 - lam
    up = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(F.abs(two) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, two) - 1) / two)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_of(x: np.ndarray, lam: float) -> np.ndarray:
    """The transform of a worker's values."""
    up, down = np.maximum(x, 0.0), np.maximum(-x, 0.0)
    high = np.log1p(up) if abs(lam) < 1e-9 else (np.power(up + 1, lam) - 1) / lam
    low = -np.log1p(down) if abs(2 - lam) < 1e-9 else -(np.power(down + 1, 2 - lam) - 1) / (2 - lam)
    return np.where(x >= 0, high, low)


#: Exponents compared in one pass, and passes: each narrows the interval 64-fold.
GRID, PASSES = 129, 5


def power_parameters(on: DataFrame, names: list[str], low: float = -5.0, high: float = 5.0, count: str | None = None) -> dict[str, tuple[float, float, float]]:
    """Exponent of the greatest likelihood, mean and deviation of each column; exponent 1 for a constant one.

    The likelihood is a sum over distinct values and their counts, taken by the executors for all columns and a grid
    of exponents at once; the interval narrows round the best one. Nothing but sums reaches the driver. A row of ``on``
    stands for as many as its column ``count`` says, where given.
    """
    spark = on.sparkSession
    cells = on.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in names])).alias("c"), (F.col(count) if count else F.lit(1)).cast("long").alias("m")).select("c.*", "m")
    values = Scratch(spark, "power").save(cells.where("x is not null").groupBy("name", "x").agg(F.sum("m").alias("n")), "values")
    base = values.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("distinct"), F.sum(F.col("n") * F.signum("x") * F.log1p(F.abs("x"))).alias("logs")).collect()
    fixed = {r["name"]: r for r in base}
    span = {n: (low, high) for n in fixed}

    def sums(exponents: dict[str, list[float]]) -> list:
        table = spark.createDataFrame([(n, lam) for n, many in exponents.items() for lam in many], "name string, lam double")
        y = yeo_johnson(F.col("x"), F.col("lam"))
        moved = values.join(F.broadcast(table), "name").select("name", "lam", "n", y.alias("y"))
        return moved.groupBy("name", "lam").agg(F.sum(F.col("n") * F.col("y")).alias("s"), F.sum(F.col("n") * F.col("y") * F.col("y")).alias("q")).collect()

    def spread(r, n: int) -> tuple[float, float]:
        mean = r["s"] / n
        return mean, max(r["q"] / n - mean * mean, 0.0)

    varied = [n for n in fixed if fixed[n]["distinct"] > 1]
    for _ in range(PASSES if varied else 0):
        best: dict[str, tuple[float, float]] = {}
        for r in sums({n: np.linspace(*span[n], GRID).tolist() for n in varied}):
            f = fixed[r["name"]]
            _, var = spread(r, f["n"])
            like = -f["n"] / 2 * np.log(var) + (r["lam"] - 1) * f["logs"] if var > 0 else -np.inf
            best[r["name"]] = max(best.get(r["name"], (-np.inf, r["lam"])), (like, r["lam"]))
        for n, (_, lam) in best.items():
            step = (span[n][1] - span[n][0]) / (GRID - 1)
            span[n] = (max(low, lam - step), min(high, lam + step))
    chosen = {n: (span[n][0] + span[n][1]) / 2 if n in varied else 1.0 for n in fixed}
    out = {}
    for r in sums({n: [lam] for n, lam in chosen.items()}):
        mean, var = spread(r, fixed[r["name"]]["n"])
        out[r["name"]] = (chosen[r["name"]], mean, var**0.5 or 1.0)
    return out


def power_scaled(df: DataFrame, names: list[str], on: DataFrame | None = None) -> DataFrame:
    """Yeo-Johnson with fitted exponents, then zero mean and unit deviation; fitted on ``on``, where given."""
    q = power_parameters(df if on is None else on, names)

    def scaled(n: str) -> Column:
        if n not in q:
            return F.lit(None).cast("double")
        lam, mean, dev = q[n]
        return (yeo_johnson(F.col(n).cast("double"), lam) - mean) / dev

    return df.withColumns({n: scaled(n) for n in names})
