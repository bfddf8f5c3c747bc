"""Moving a model to another domain: scale-factor ranges, searches over factors and weights, refinement by coupled models, calibration, augmentation.

A model here is a function DataFrame -> DataFrame that adds prediction columns; rows stay separate, so a candidate is one more column of the exploded
rows, and every search step is one job with one aggregate a candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.columns import hash_normal, hash_uniform, in_range, masked, numeric_columns
from causeway.functions.scratch import stored
from causeway.functions.windows import exact_percentiles, positions
from causeway.operators import stats

Model = Callable[[DataFrame], DataFrame]
EPS = 1e-6
#: Most candidates of a joint search, each a number or two; every row meets each.
MOST_CANDIDATES = 100_000


def cluster_of(x: Column, bounds: Sequence[float]) -> Column:
    """i for bounds[i] <= x < bounds[i + 1], null outside."""
    return reduce(lambda acc, i: F.when((x >= bounds[i]) & (x < bounds[i + 1]), i).otherwise(acc), range(len(bounds) - 1), F.lit(None).cast("int"))


def scale_ranges(a: DataFrame, b: DataFrame, col: str, bounds: Sequence[float], variant: str = "percentile", cap: float | None = None) -> DataFrame:
    """(cluster, s_min, s_max) of factors that bring domain b to domain a.

    percentile: p5 / p99 and p95 / p1, both by cluster; minmax: extremes instead (cap 25); median: a's percentiles over the median of b's
    non-zero values (cap 25); whole: a's 5/95 percentiles not clustered, b's 5/95. A cluster empty on either side is left out.
    """
    cap = 25.0 if cap is None and variant in ("minmax", "median") else cap
    split = lambda df: df.select(cluster_of(F.col(col), bounds).alias("cluster"), F.col(col).cast("double").alias("x")).filter("cluster is not null")

    def ends(df: DataFrame, ps: list[float] | None, side: str, by: list[str]) -> DataFrame:
        """(by..., lo_<side>, hi_<side>): the percentiles ps, or the extremes."""
        if ps is None:
            return df.groupBy(*by).agg(F.min("x").alias(f"lo_{side}"), F.max("x").alias(f"hi_{side}"))
        return exact_percentiles(df, "x", ps, by).select(*by, F.col("q")[0].alias(f"lo_{side}"), F.col("q")[1].alias(f"hi_{side}"))

    own = {"percentile": [0.05, 0.95], "minmax": None, "median": [0.05, 0.95], "whole": [0.05, 0.95]}[variant]
    other = {"percentile": [0.01, 0.99], "minmax": None, "median": [0.5, 0.5], "whole": [0.05, 0.95]}[variant]
    right = ends(split(b).filter("x <> 0") if variant == "median" else split(b), other, "b", ["cluster"])
    if variant == "whole":
        both = right.crossJoin(F.broadcast(ends(a.select(F.col(col).cast("double").alias("x")), own, "a", [])))  # one row
    else:
        both = ends(split(a), own, "a", ["cluster"]).join(right, "cluster")
    s_min = F.greatest(F.col("lo_a") / F.greatest(F.col("hi_b"), F.lit(EPS)), F.lit(0.01))
    s_max = F.col("hi_a") / F.greatest(F.col("lo_b"), F.lit(EPS))
    return both.select("cluster", s_min.alias("s_min"), (F.least(s_max, F.lit(float(cap))) if cap else s_max).alias("s_max"))


def apply_mid_factors(df: DataFrame, ranges: DataFrame, col: str, bounds: Sequence[float]) -> DataFrame:
    """df with col times the middle factor of its cluster; rows without a cluster or a range stay."""
    mid = ranges.select("cluster", ((F.col("s_min") + F.col("s_max")) / 2).alias("mid_"))
    rows = df.withColumn("cluster", cluster_of(F.col(col), bounds)).join(F.broadcast(mid), "cluster", "left")  # a row a cluster
    return rows.withColumn(col, F.col(col) * F.coalesce("mid_", F.lit(1.0))).select(*df.columns)


@dataclass(frozen=True)
class Objective:
    """What a search maximises: r2, -mse, tolerance score, or r2 among candidates within MSE limits (the best of all, if none is)."""

    pairs: tuple[tuple[str, str], ...]
    kind: str = "r2"
    tolerances: tuple[float, ...] = ()
    limits: tuple[float, ...] = ()

    def aggregates(self) -> list[Column]:
        cols = [(F.col(y), F.col(p)) for y, p in self.pairs]
        mean = lambda xs: reduce(lambda a, b: a + b, xs) / len(xs)
        value = {
            "r2": lambda: mean([stats.r2(y, p) for y, p in cols]),
            "mse": lambda: -mean([stats.mse(y, p) for y, p in cols]),
            "tolerance": lambda: mean([stats.tolerance_score(y, p, t) for (y, p), t in zip(cols, self.tolerances)]),
            "constrained": lambda: mean([stats.r2(y, p) for y, p in cols]),
        }[self.kind]()
        ok = reduce(lambda a, b: a & b, [stats.mse(y, p) <= t for (y, p), t in zip(cols, self.limits)], F.lit(True)) if self.kind == "constrained" else F.lit(True)
        return [value.alias("value"), ok.alias("ok")]

    def of_cells(self, spread: dict[str, float | None]) -> list[Column]:
        """The same of cells (stats.cells); spread: each truth's sum of squared deviations over all rows."""
        fit = {y: stats.sse(y, F.col(p)) for y, p in self.pairs}
        mean_error = {y: fit[y] / F.sum(F.when(F.col(p).isNotNull(), F.col(f"n_{y}"))) for y, p in self.pairs}
        one = {
            "mse": lambda y, _: -mean_error[y],
            "tolerance": lambda y, k: 1 - mean_error[y] / F.lit(float(self.tolerances[k])),
        }.get(self.kind, lambda y, _: 1 - fit[y] / F.lit(spread[y]).cast("double"))
        value = reduce(lambda a, b: a + b, [one(y, k) for k, (y, _) in enumerate(self.pairs)]) / len(self.pairs)
        ok = reduce(lambda a, b: a & b, [mean_error[y] <= t for (y, _), t in zip(self.pairs, self.limits)], F.lit(True)) if self.kind == "constrained" else F.lit(True)
        return [value.alias("value"), ok.alias("ok")]


def merged(df: DataFrame, cols: Sequence[str], objective: Objective, reads: Sequence[str] | None) -> tuple[DataFrame, list[Column]]:
    """(the rows that candidates meet, the aggregates that score them). With reads, all columns that the model and a mask read, rows that are equal there are one, predicted once a candidate.

    Without it, or if it names a truth, they are df's own rows. The cells are stored: every candidate meets them, the table is read once.
    """
    truths = list(dict.fromkeys(y for y, _ in objective.pairs))
    if not reads or set(truths) & {*reads, *cols}:
        return df, objective.aggregates()
    spread = df.agg(*[(F.var_pop(y) * F.count(y)).alias(f"s{i}") for i, y in enumerate(truths)]).first()
    by = list(dict.fromkeys([*reads, *cols]))
    return stored(stats.cells(df, by, truths), "cells"), objective.of_cells({y: spread[f"s{i}"] for i, y in enumerate(truths)})


def search(df: DataFrame, col: str, factors: Sequence[float], model: Model, objective: Objective, mask: Column | None = None, reads: Sequence[str] | None = None) -> DataFrame:
    """(i, factor, value, ok) of every candidate: col times the factor (where the mask holds), predicted, scored. One pass over df, or over its cells (reads: as in merged)."""
    df, scores = merged(df, [col], objective, reads)
    listed = F.array(*[F.struct(F.lit(i).alias("i_"), F.lit(float(f)).alias("factor_")) for i, f in enumerate(factors)])
    rows = df.select("*", F.inline(listed))
    rows = rows.withColumn(col, masked(F.col(col), F.lit(True) if mask is None else mask, F.col(col) * F.col("factor_")))
    return model(rows).groupBy(F.col("i_").alias("i"), F.col("factor_").alias("factor")).agg(*scores)


def best_of(scored: DataFrame) -> DataFrame:
    """(factor, value): the best candidate, the first on ties; those within limits go first."""
    return scored.agg(F.max(F.struct(F.col("ok"), F.col("value"), -F.col("i"), F.col("factor"))).alias("b")).select("b.factor", "b.value")


def frange(lo: float, hi: float, step: float) -> list[float]:
    return [round(lo + i * step, 10) for i in range(int(round((hi - lo) / step)) + 1)]


DEFAULT_FACTORS = frange(0.1, 20.0, 0.1)


def greedy_scale_search(df: DataFrame, cols: Sequence[str], model: Model, objective: Objective, factors: Sequence[float] | dict[str, Sequence[float]] = DEFAULT_FACTORS, reads: Sequence[str] | None = None) -> tuple[dict[str, float], DataFrame]:
    """Coordinate-wise: the best factor of each column in turn, columns before it scaled already. Returns factors and the scaled table. reads: as in merged."""
    found = {}
    for c in cols:
        own = factors.get(c, DEFAULT_FACTORS) if isinstance(factors, dict) else factors
        found[c] = best_of(search(df, c, own, model, objective, reads=reads)).first()["factor"]
        df = df.withColumn(c, F.col(c) * F.lit(found[c]))
    return found, df


@dataclass(frozen=True)
class ClusterSpec:
    """Candidate factors of the rows with lo <= x <= hi (both ends closed, so neighbours share their edge)."""

    lo: float
    hi: float
    factors: tuple[float, ...]


def cluster_scale_search(df: DataFrame, col: str, specs: Sequence[ClusterSpec], model: Model, objective: Objective, reads: Sequence[str] | None = None) -> tuple[list[float], DataFrame]:
    """The best factor of each cluster, each judged with the rest of the column unscaled; then all applied, the last cluster winning on a shared edge. reads: as in merged."""
    found = []
    for s in specs:
        mask = in_range(F.col(col), s.lo, s.hi, closed=True)
        found.append(best_of(search(df, col, s.factors, model, objective, mask, reads)).first()["factor"])
    factor = reduce(lambda acc, sf: F.when(in_range(F.col(col), sf[0].lo, sf[0].hi, closed=True), F.lit(sf[1])).otherwise(acc), zip(specs, found), F.lit(1.0))
    return found, df.withColumn(col, F.col(col) * factor)


def weight_search(df: DataFrame, cols: Sequence[str], model: Model, objective: Objective, lo: float = 0.1, hi: float = 3.0, step: float = 0.01, reads: Sequence[str] | None = None) -> tuple[dict[str, float], DataFrame]:
    """One global weight a column after cluster scaling, columns in turn. reads: as in merged."""
    return greedy_scale_search(df, cols, model, objective, frange(lo, hi, step), reads)


def joint_search(df: DataFrame, candidates: DataFrame, cols: Sequence[str], model: Model, objective: Objective, reads: Sequence[str] | None = None) -> DataFrame:
    """candidates (i, f_<col>...) with value and ok: all columns scaled at once. candidates is a small table of the search's own, broadcast. reads: as in merged."""
    if candidates.limit(MOST_CANDIDATES + 1).count() > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidates: search them in parts")
    df, scores = merged(df, cols, objective, reads)
    rows = df.crossJoin(F.broadcast(candidates))
    rows = rows.withColumns({c: F.col(c) * F.col(f"f_{c}") for c in cols})
    return model(rows).groupBy("i", *[f"f_{c}" for c in cols]).agg(*scores)


def grid_candidates(spark, grids: dict[str, Sequence[float]]) -> DataFrame:
    """(i, f_<col>...): the cartesian product of factors, numbered in order."""
    from itertools import product

    rows = [(i, *map(float, combo)) for i, combo in enumerate(product(*grids.values()))]
    return spark.createDataFrame(rows, "i int, " + ", ".join(f"f_{c} double" for c in grids))


def random_candidates(spark, cols: Sequence[str], n: int, lo: float = 0.05, hi: float = 5.0) -> DataFrame:
    """(i, f_<col>...): n uniform draws, repeatable by number."""
    base = spark.range(n).select(F.col("id").cast("int").alias("i"))
    return base.select("i", *[(hash_uniform(F.col("i"), k) * (hi - lo) + lo).alias(f"f_{c}") for k, c in enumerate(cols)])


def refine(df: DataFrame, first: Model, second: Model, third: Model, rounds: int = 5) -> DataFrame:
    """first gives both predictions; then rounds times second renews one from the other and third the other from the new one. All in one lazy plan."""
    out = first(df)
    for _ in range(rounds):
        out = third(second(out))
    return out


@dataclass
class Calibration:
    """A fitted calibration with the rows it was fitted on and judged by; equal sets make the score an in-sample one."""

    kind: str
    model: object
    fit_rows: int
    features: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame, prediction: str, out: str) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        rows = VectorAssembler(inputCols=[prediction], outputCol="p_").transform(df) if self.kind == "isotonic" else powers(df, prediction, len(self.features))
        return self.model.transform(rows).withColumnRenamed("prediction", out).drop("p_", *self.features)


def powers(df: DataFrame, col: str, degree: int) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    names = [f"pow{k}_" for k in range(1, degree + 1)]
    return VectorAssembler(inputCols=names, outputCol="p_").transform(df.withColumns({n: F.pow(F.col(col), F.lit(float(k))) for k, n in enumerate(names, 1)}))


def calibrate_polynomial(df: DataFrame, prediction: str, truth: str, degree: int = 5) -> Calibration:
    from pyspark.ml.regression import LinearRegression

    rows = powers(df, prediction, degree)
    return Calibration("polynomial", LinearRegression(featuresCol="p_", labelCol=truth, solver="normal").fit(rows), df.count(), [f"pow{k}_" for k in range(1, degree + 1)])


def calibrate_isotonic(df: DataFrame, prediction: str, truth: str) -> Calibration:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = VectorAssembler(inputCols=[prediction], outputCol="p_").transform(df)
    return Calibration("isotonic", IsotonicRegression(featuresCol="p_", labelCol=truth).fit(rows), df.count())


def augment_noise(df: DataFrame, key: str, cols: Sequence[str], sigma: float = 0.05, exclusive: tuple[str, str] | None = None) -> DataFrame:
    """df and one noisy copy of each row: normal noise of sigma column deviations (repeatable by key), never below 0; of an exclusive pair, the second is 0 where the first is not."""
    sd = df.agg(*[F.stddev_samp(c).alias(f"sd_{c}") for c in cols])
    noisy = df.crossJoin(F.broadcast(sd))  # one row
    noisy = noisy.withColumns({c: F.greatest(F.col(c) + hash_normal(F.col(key), i) * F.col(f"sd_{c}") * sigma, F.lit(0.0)) for i, c in enumerate(cols)}).select(*df.columns)
    if exclusive:
        noisy = noisy.withColumn(exclusive[1], masked(F.col(exclusive[1]), F.col(exclusive[0]) > 0, F.lit(0.0)))
    return df.unionByName(noisy)


def augment_interpolate(df: DataFrame, key: str, cols: Sequence[str] | None = None, shift: int | None = 7, seed: int = 42, exclusive: tuple[str, str] | None = None, low: float | None = 0.0) -> DataFrame:
    """df and a convex combination of each row with another, by a repeatable weight; other columns of new rows are null.

    Of an exclusive pair of columns no new row keeps both: the second becomes 0 where the first is above 0, then the first where the second is. New values
    below low become low (None: they stay). A null in either row of a pair makes a null. key is an integer.

    The other row is that of key + shift (where there is one) or, without shift, the next one in a seeded random order of all rows (the first for the last), so every row has a random partner.
    """
    cols = list(cols or [c for c in numeric_columns(df) if c != key])
    w = hash_uniform(F.col(key), 1)
    if shift is None:
        placed = positions(df.select(key, *cols), [], [hash_uniform(F.col(key), seed), F.col(key)], "at_")
        placed = stored(placed, "placed")
        n = placed.count()
        other = placed.select(F.when(F.col("at_") == 1, n).otherwise(F.col("at_") - 1).alias("at_"), *[F.col(c).alias(f"o_{c}") for c in cols])
        pairs = placed.join(other, "at_")
    else:
        pairs = df.select(key, *cols).join(df.select((F.col(key) - shift).alias(key), *[F.col(c).alias(f"o_{c}") for c in cols]), key)
    new = pairs.select(*[(F.col(c) * w + F.col(f"o_{c}") * (1 - w)).alias(c) for c in cols])
    for a, b in (exclusive, exclusive[::-1]) if exclusive else ():
        new = new.withColumn(b, masked(F.col(b), F.col(a) > 0, F.lit(0.0)))
    if low is not None:
        new = new.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(low))) for c in cols})
    return df.unionByName(new, allowMissingColumns=True)
