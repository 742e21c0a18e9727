"""Command line: time products of a matrix, or compute A^r x and compare it with plain products."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from .config import SpmvConfig, parse
from .operators import exact, iterate, stats, validate
from .plans.matrix import SparseMatrix, Vector, constant, random_vector
from .plans.tables import written
from .sources import generate, matrix_market, reports


def load(spark: SparkSession, name: str) -> SparseMatrix:
    """A Matrix Market file, or stencil:SIDE, band:N:LOWER:UPPER, random:N:PER_ROW."""
    kind, _, rest = name.partition(":")
    if kind in ("stencil", "band", "random"):
        numbers = [int(x) for x in rest.split(":")]
        return {"stencil": generate.stencil_2d, "band": generate.band, "random": generate.random_matrix}[kind](spark, *numbers)
    return matrix_market.read_matrix(spark, name)


def first_vector(a: SparseMatrix, config: SpmvConfig) -> Vector:
    """5.0 everywhere, the middle of the entries' sizes, or uniform between the least and the largest."""
    if config.random_x == "0":
        return constant()
    r = stats.value_range(a).first()
    low, middle, high = (float(x or 0.0) for x in (r.min_abs, r.midrange, r.max_abs))
    return constant(middle) if config.random_x == "m" else random_vector(a.spark, a.n_cols, low, high, config.seed)


def solve(a: SparseMatrix, config: SpmvConfig) -> DataFrame:
    """`repetitions` products in the configured format and precision: (i, y)."""
    if not a.square:
        raise ValueError("iterated products need a square matrix")
    x = first_vector(a, config)
    for k in range(config.repetitions):
        y = iterate.execute(a, config, x)
        x = (written(y) if k % 4 == 3 else y).withColumnRenamed("y", "x")
    return x.withColumnRenamed("x", "y")


def run(spark: SparkSession, config: SpmvConfig) -> DataFrame:
    """The figures of bench mode, or the summary of a comparison in solve mode."""
    a = load(spark, config.matrix)
    if config.mode == "bench":
        figures = iterate.benchmark(a, config)
        if config.output:
            reports.append_figures(figures, config.output)
        return figures
    y = solve(a, config)
    if not config.validate:
        return y
    compared = validate.compare(y, exact.power_exact(a, first_vector(a, config), config.repetitions))
    if config.output:
        reports.append_comparison(compared, config.output)
    return validate.summary(compared)


if __name__ == "__main__":
    session = SparkSession.builder.appName("loomatrix").getOrCreate()
    run(session, parse(sys.argv[1:])).show(truncate=False)
