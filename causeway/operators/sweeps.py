"""The best scale factor of a tree ensemble's input, exactly: predictions are piecewise constant in the factor, so a sweep over breakpoints sees all of them.

A split ``x * factor <= t`` turns at ``factor = t / x``. Between two turns a row's prediction doesn't change, so a row has as many predictions as the ensemble has
thresholds on the column, plus one (an ensemble of pyspark.ml has at most maxBins of them for each fit, however many trees). Each prediction is a step
of the row's loss; steps of all rows, summed by breakpoint and added up in order, are the loss at every factor. A grid of factors predicts every row once a
factor and sees only the grid; the sweep predicts it once a threshold and misses none.

Scale: one job predicts rows times thresholds, one aggregate sums steps by breakpoint (map-side), and running totals go over ranges of breakpoints.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.scratch import stored
from causeway.functions.windows import running_totals
from causeway.operators import stats
from causeway.operators.models import RefinedModel

Model = Callable[[DataFrame], DataFrame]
SPLIT = re.compile(r"If \(feature (\d+) <= ([^)\s]+)\)")


def thresholds(model: RefinedModel | PipelineModel, col: str) -> list[float]:
    """The values, ascending, at which the trees of a model (all of a refined model's) split the numeric column col."""
    if isinstance(model, RefinedModel):
        return sorted({t for m in (*model.first, *(model.second if model.rounds else ())) for t in thresholds(m, col)})
    inputs = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    return sorted({float(t) for s in model.stages if hasattr(s, "toDebugString") for i, t in SPLIT.findall(s.toDebugString) if inputs[int(i)] == col})


def steps(df: DataFrame, col: str, at: Sequence[float], low: float, high: float, mask: Column | None = None) -> DataFrame:
    """df with a row for every stretch (from_, to_) of factors between low and high in which col * factor stays between two thresholds; col is a value between them.

    Rows that a factor can't move (0, null, NaN, or outside the mask) have the one stretch from low to high and keep their value.
    """
    ends = [None, *at, None]
    between = [(at[0] if at else 0.0), *at[1:], at[-1] + max(1.0, abs(at[-1]))] if at else [0.0]  # a split goes left at its threshold
    known = F.array(*[F.struct(F.lit(float(v)).alias("v"), F.lit(a).cast("double").alias("a"), F.lit(b).cast("double").alias("b")) for v, a, b in zip(between, ends, ends[1:])])
    x, lo, hi = F.col(col).cast("double"), F.lit(float(low)), F.lit(float(high))
    moved = (x != 0) & ~F.isnan(x) & (F.lit(True) if mask is None else mask)
    stretch = lambda v, a, b: F.struct(v.alias("v"), a.alias("a"), b.alias("b"))
    turned = F.transform(known, lambda s: stretch(s["v"], F.greatest(F.when(x > 0, s["a"] / x).otherwise(s["b"] / x), lo), F.least(F.when(x > 0, s["b"] / x).otherwise(s["a"] / x), hi)))
    each = F.when(moved, F.filter(turned, lambda s: s["a"] < s["b"])).otherwise(F.array(stretch(x, lo, hi))) if at else F.array(stretch(x, lo, hi))
    rows = df.withColumn("step_", F.explode(each))
    return rows.withColumns({col: F.col("step_.v"), "from_": F.col("step_.a"), "to_": F.col("step_.b")}).drop("step_")


def losses(df: DataFrame, col: str, at: Sequence[float], model: Model, pairs: Sequence[tuple[str, str]], low: float, high: float, mask: Column | None = None, reads: Sequence[str] | None = None) -> DataFrame:
    """(factor, sse_<i>...): the sum of squared errors of each pair (truth, prediction) from that factor up to the next row's. Stored.

    Factors on a breakpoint itself are left to either side. Rows without a truth or a prediction count in no sum. reads: all columns that the model and the
    mask read, none of them a truth; rows that are equal there are predicted once a threshold.
    """
    truths = list(dict.fromkeys(y for y, _ in pairs))
    cells = bool(reads) and not set(truths) & {*reads, col}
    rows = model(steps(stored(stats.cells(df, list(dict.fromkeys([*reads, col])), truths), "cells") if cells else df, col, at, low, high, mask))
    errors = [F.coalesce(stats.cell_error(y, F.col(p)) if cells else F.pow(F.col(y) - F.col(p), F.lit(2.0)), F.lit(0.0)) for y, p in pairs]
    events = rows.select(F.inline(F.array(*[F.struct(F.col(end).alias("factor"), *[(e * sign).alias(f"d{i}_") for i, e in enumerate(errors)]) for end, sign in (("from_", 1.0), ("to_", -1.0))])))
    names = [f"d{i}_" for i in range(len(pairs))]
    summed = stored(events.groupBy("factor").agg(*[F.sum(n).alias(n) for n in names]), "steps")
    return stored(running_totals(summed, "factor", names).select("factor", *[F.col(f"cum_{n}").alias(f"sse_{i}") for i, n in enumerate(names)]), "losses").filter(F.col("factor") < high)


def sweep_factor(df: DataFrame, col: str, at: Sequence[float], model: Model, pairs: Sequence[tuple[str, str]], kind: str = "r2", low: float = 0.1, high: float = 20.0, mask: Column | None = None, reads: Sequence[str] | None = None) -> dict[str, float]:
    """{low, high, factor, value}: the stretch of factors of col with the best mean R2 (kind r2) or least mean MSE (mse, as -MSE), its middle, and that value.

    at: thresholds(model, col), or those that any piecewise constant model has. Of equally good stretches (to 12 digits) the lowest counts. A target that
    doesn't vary has R2 0; a table without rows has value NaN and the whole range. reads: as in losses. ValueError unless low < high and kind is known.
    """
    if not low < high or kind not in ("r2", "mse"):
        raise ValueError("need low < high, and kind r2 or mse")
    sums = df.agg(*[x for i, (y, _) in enumerate(pairs) for x in (F.count(F.when(~F.isnan(F.col(y).cast("double")), 1)).alias(f"n{i}"), F.var_pop(y).alias(f"v{i}"))]).first()
    total = [sums[f"n{i}"] * (sums[f"v{i}"] or 0.0) for i in range(len(pairs))]
    if not any(sums[f"n{i}"] for i in range(len(pairs))):
        return {"low": low, "high": high, "factor": (low + high) / 2, "value": math.nan}
    one = {
        "r2": lambda i: (1 - F.col(f"sse_{i}") / total[i]) if total[i] else F.lit(0.0),
        "mse": lambda i: -F.col(f"sse_{i}") / max(sums[f"n{i}"], 1),
    }[kind]
    scored = losses(df, col, at, model, pairs, low, high, mask, reads).withColumn("value", sum((one(i) for i in range(len(pairs))), F.lit(0.0)) / len(pairs))
    best = scored.agg(F.max(F.struct(F.round("value", 12).alias("r"), -F.col("factor"), F.col("factor"), F.col("value"))).alias("b")).select("b.factor", "b.value").first()
    after = scored.filter(F.col("factor") > best["factor"]).agg(F.min("factor")).first()[0]
    end = high if after is None else after
    return {"low": best["factor"], "high": end, "factor": (best["factor"] + end) / 2, "value": best["value"]}


def greedy_sweep(df: DataFrame, at: dict[str, Sequence[float]], model: Model, pairs: Sequence[tuple[str, str]], kind: str = "r2", low: float = 0.1, high: float = 20.0, reads: Sequence[str] | None = None) -> tuple[dict[str, dict[str, float]], DataFrame]:
    """Columns of at in turn, each swept with those before it scaled: {column: as sweep_factor gives}, and the scaled table."""
    found = {}
    for c, own in at.items():
        found[c] = sweep_factor(df, c, own, model, pairs, kind, low, high, None, reads)
        df = df.withColumn(c, F.col(c) * F.lit(found[c]["factor"]))
    return found, df


def cluster_sweep(df: DataFrame, col: str, bounds: Sequence[tuple[float, float]], at: Sequence[float], model: Model, pairs: Sequence[tuple[str, str]], kind: str = "r2", low: float = 0.1, high: float = 20.0, reads: Sequence[str] | None = None) -> tuple[list[dict[str, float]], DataFrame]:
    """A factor for the rows of each half-open range [a, b) of col, each swept with the rest unscaled; then all applied."""
    inside = [(F.col(col) >= a) & (F.col(col) < b) for a, b in bounds]
    found = [sweep_factor(df, col, at, model, pairs, kind, low, high, m, reads) for m in inside]
    factor = F.lit(1.0)
    for m, f in zip(inside, found):
        factor = F.when(m, F.lit(f["factor"])).otherwise(factor)
    return found, df.withColumn(col, F.col(col) * factor)
