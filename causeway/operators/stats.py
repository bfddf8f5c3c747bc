"""Contingency tables, entropies, metrics and tests."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.functions.scratch import stored
from causeway.functions.windows import exact_percentiles, running_totals


#: Numbers that exact tests of one array have in a step: they stay in a core's cache.
PATHS = 1 << 15


def reserved(cols: Iterable[str], *names: str) -> None:
    """ValueError if a column has the name of one that the operator adds."""
    if clash := sorted(set(cols) & set(names)):
        raise ValueError(f"rename these columns, the result needs their names: {', '.join(clash)}")


def contingency(df: DataFrame, cols: list[str]) -> DataFrame:
    """(cols..., n): the one pass over the data from which all frequency operators work.

    Complete cases only: rows with a null or NaN among cols are left out here, once, so that tables made from the counts sum to 1 and agree with each other.
    """
    reserved(cols, "n")
    return df.na.drop(subset=list(cols)).groupBy(*cols).agg(F.count("*").alias("n"))


def set_sums(counts: DataFrame, sets: Iterable[frozenset[str]], cols: list[str]) -> DataFrame:
    """(names array<string>, s = sum of n ln n, cells, total) of every marginal in sets, by one aggregate with grouping sets. The empty set is allowed."""
    wanted = sorted({tuple(c for c in cols if c in v) for v in sets})
    own = [c for c in cols if any(c in v for v in wanted)]
    full = [list(v) for v in wanted if v]
    parts = []
    if full:
        cells = counts.select(*own, "n").groupingSets([[F.col(c) for c in v] for v in full], *[F.col(c) for c in own]).agg(F.sum("n").alias("n"), *[F.grouping(c).alias(f"g_{c}") for c in own])
        names = F.filter(F.array(*[F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in own]), lambda x: x.isNotNull())
        parts.append(cells.select(names.alias("names"), F.col("n").cast("double").alias("n")))
    if any(not v for v in wanted):
        parts.append(counts.agg(F.sum("n").cast("double").alias("n")).select(F.array().cast("array<string>").alias("names"), "n"))
    return reduce(DataFrame.unionByName, parts).groupBy("names").agg(F.sum(F.col("n") * F.log("n")).alias("s"), F.count("*").alias("cells"), F.sum("n").alias("total"))


def set_table(counts: DataFrame, sets: Iterable[frozenset[str]], cols: list[str]) -> dict[frozenset[str], tuple[float, int, float]]:
    """set_sums on the driver: a row a set, whatever the data's size."""
    return {frozenset(r["names"]): (r["s"], r["cells"], r["total"]) for r in set_sums(counts, sets, cols).collect()}


def entropy_bits(s: float, total: float) -> float:
    """Joint entropy in bits from s = sum of n ln n."""
    return (math.log(total) - s / total) / math.log(2) if total else 0.0


def relative_frequency(counts: DataFrame, within: list[str], out: str = "p") -> DataFrame:
    """counts with n over the total of its group (all rows, if within is empty)."""
    reserved(counts.columns, out)
    if within:
        return counts.withColumn(out, F.col("n").cast("double") / F.sum("n").over(W.partitionBy(*within)))
    total = counts.agg(F.sum("n").cast("double").alias("total_"))
    return counts.crossJoin(F.broadcast(total)).withColumn(out, F.col("n") / F.col("total_")).drop("total_")


def conditional_mutual_information(df: DataFrame, pairs: list[tuple[str, str, tuple[str, ...]]], epsilon: float = 1e-5) -> DataFrame:
    """(x, y, given, cmi, d_separated) for every (x, y, given) in pairs, in bits; one grouping-sets pass for all of them."""
    cols = sorted({c for x, y, z in pairs for c in (x, y, *z)})
    need = {frozenset(v) for x, y, z in pairs for v in ((x, *z), (y, *z), (x, y, *z), z)}
    t = set_table(contingency(df, cols), need, cols)
    h = lambda *v: entropy_bits(t[frozenset(v)][0], t[frozenset(v)][2])
    rows = [(x, y, list(z), h(x, *z) + h(y, *z) - h(x, y, *z) - h(*z)) for x, y, z in pairs]
    return df.sparkSession.createDataFrame([(*r, r[3] < epsilon) for r in rows], "x string, y string, given array<string>, cmi double, d_separated boolean")


def powerset(items: Iterable[str]) -> list[tuple[str, ...]]:
    items = list(items)
    return [c for k in range(len(items) + 1) for c in combinations(items, k)]


def r2(y: Column, p: Column) -> Column:
    """1 - SSE / SST as an aggregate."""
    return 1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))


def cells(df: DataFrame, by: Sequence[str], truths: Sequence[str]) -> DataFrame:
    """(by..., n_<y>, mean_<y>, dev_<y>): rows with equal by as one, with each truth's count, mean and sum of squared deviations.

    Where by is all that a model reads, one prediction a cell does for its rows, and sse of it is their sum of squared errors without cancellation.
    """
    reserved(by, *[f"{k}_{y}" for y in truths for k in ("n", "mean", "dev")])
    return df.groupBy(*by).agg(*[x for y in truths for x in (F.count(y).alias(f"n_{y}"), F.avg(y).alias(f"mean_{y}"), (F.var_pop(y) * F.count(y)).alias(f"dev_{y}"))])


def cell_error(y: str, p: Column) -> Column:
    """The sum of squared errors of a cell's rows, all predicted p."""
    return F.col(f"dev_{y}") + F.col(f"n_{y}") * (F.col(f"mean_{y}") - p) * (F.col(f"mean_{y}") - p)


def sse(y: str, p: Column) -> Column:
    """The sum of squared errors of cells that have the prediction p, as an aggregate."""
    return F.sum(cell_error(y, p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def tolerance_score(y: Column, p: Column, tolerance: float) -> Column:
    return 1 - mse(y, p) / F.lit(float(tolerance))


def regression_metrics(df: DataFrame, pairs: list[tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """(by..., <y>_r2, <y>_mse, <y>_mae, ..., r2, mse, mae): per target and their uniform means."""
    one = [(n, f(F.col(y), F.col(p)).alias(f"{y}_{n}")) for y, p in pairs for n, f in (("r2", r2), ("mse", mse), ("mae", mae))]
    out = df.groupBy(*(by or [])).agg(*[a for _, a in one])
    mean = lambda n: reduce(lambda a, b: a + b, [F.col(f"{y}_{n}") for y, _ in pairs]) / len(pairs)
    return out.withColumns({n: mean(n) for n in ("r2", "mse", "mae")})


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, corr) of all ordered pairs, from one aggregate of the upper triangle."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cell = lambda a, b, v: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), v.alias("corr"))
    cells = [cell(c, c, F.lit(1.0)) for c in cols] + [cell(x, y, F.col(f"c{i}")) for i, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
    return row.select(F.inline(F.array(*cells)))


def ks_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., ks, n_a, n_b) from (by..., __v, __a, __b): how often each sample has the value __v."""
    reserved(by, "ks", "n_a", "n_b")
    rows = running_totals(counts, "__v", ["__a", "__b"], by).withColumnsRenamed({"all___a": "n_a", "all___b": "n_b"}).filter("n_a > 0 and n_b > 0")
    gap = F.abs(F.col("cum___a").cast("double") / F.col("n_a") - F.col("cum___b").cast("double") / F.col("n_b"))
    return rows.groupBy(*by, "n_a", "n_b").agg(F.max(gap).alias("ks")).select(*by, "ks", "n_a", "n_b")


def ks_statistic(a: DataFrame, b: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., ks, n_a, n_b): the largest distance of the two empirical distribution functions. Nulls don't count.

    Counts a value are summed and stored first, so each sample is read once; cumulative counts run over ranges of values.
    """
    by = by or []
    one = lambda df, i, j: df.select(*by, F.col(value).alias("__v"), F.lit(i).alias("__a"), F.lit(j).alias("__b"))
    both = one(a, 1, 0).unionByName(one(b, 0, 1)).filter("__v is not null")
    return ks_of_counts(stored(both.groupBy(*by, "__v").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b")), "ks-counts"), by)


def ks_p_value(ks: float, n_a: int, n_b: int, terms: int = 100) -> float:
    """Asymptotic p-value (Kolmogorov's series), also where small samples would allow an exact one."""
    x = ks * math.sqrt(n_a * n_b / (n_a + n_b))
    return 1.0 if x < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, terms))))


def ks_exact_p(ks: float, n_a: int, n_b: int) -> float:
    """P(D >= ks) of two samples of one continuous distribution (Smirnov)."""
    return float(ks_exact_ps([ks], [n_a], [n_b])[0])


def ks_exact_ps(ks: Sequence[float], n_a: Sequence[int], n_b: Sequence[int]) -> np.ndarray:
    """P(D >= ks) of many tests, each of two samples of one continuous distribution (Smirnov); all step together.

    Orders of the pooled values are lattice paths from (0, 0) to (n_a, n_b), all equally likely. The chance that a path to (i, j) has met a point with
    |i / n_a - j / n_b| >= ks follows from its two predecessors, diagonal by diagonal. Only positive numbers are added, so small p keep their digits; the distance is
    compared in whole multiples of 1 / lcm(n_a, n_b). Tests of about one size share an array, a row a test, so a step is a few array operations for all of them.
    """
    m, n = np.minimum(n_a, n_b).astype(np.int64), np.maximum(n_a, n_b).astype(np.int64)
    whole = np.lcm(m, n)
    least, out, order = np.rint(np.asarray(ks, np.float64) * whole).astype(np.int64), np.empty(len(m)), np.lexsort((m, m + n))
    lo = 0
    while lo < len(order):
        hi = lo + max(1, PATHS // (int(m[order[lo]]) + 2))
        own = order[lo:hi]
        lo += len(own)
        a, b, most = m[own, None], n[own, None], int(m[own].max())
        up, over, far = whole[own, None] // a, whole[own, None] // b, least[own, None]
        met, i = np.zeros((len(own), most + 2)), np.arange(most + 1)  # met[:, i + 1]: at (i, s - i)
        for s in range(int((a + b).max()) + 1):
            if s:
                met[:, 1:] = (i * met[:, :-1] + np.maximum(s - i, 0) * met[:, 1:]) / s
            inside = (i <= a) & (i <= s) & (s - i <= b)
            met[:, 1:][inside & (np.abs(i * up - (s - i) * over) >= far)] = 1.0
            met[:, 1:][~inside] = 0.0  # no path comes from outside
            ended = (a + b)[:, 0] == s
            out[own[ended]] = met[ended, a[ended, 0] + 1]
    return out


def with_p_value(tests: DataFrame, exact_up_to: int = 10_000) -> DataFrame:
    """tests (ks, n_a, n_b) with p and method: 'exact' where both samples have at most exact_up_to values, else 'asymptotic'. A row a test.

    Rows are few bytes and much work (an exact test has n_a times n_b steps), so they are dealt out by number, however small the table is.
    """

    @F.pandas_udf("p double, method string")
    def p_value(ks: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.DataFrame:
        exact = (np.maximum(n_a, n_b) <= exact_up_to).to_numpy()
        p = np.array([1.0 if e else ks_p_value(d, x, y) for e, d, x, y in zip(exact, ks, n_a, n_b)], np.float64)
        p[exact] = ks_exact_ps(ks[exact].to_numpy(), n_a[exact].to_numpy(), n_b[exact].to_numpy())
        return pd.DataFrame({"p": p, "method": np.where(exact, "exact", "asymptotic")})

    reserved(tests.columns, "p", "method", "__p")
    dealt = tests.repartition(4 * tests.sparkSession.sparkContext.defaultParallelism)
    return dealt.withColumn("__p", p_value("ks", "n_a", "n_b")).select(*tests.columns, "__p.p", "__p.method")


def ks_two_sample(a: DataFrame, b: DataFrame, value: str, by: list[str] | None = None, exact_up_to: int = 10_000) -> DataFrame:
    """(by..., ks, n_a, n_b, p, method): the two-sided test of every group."""
    return with_p_value(ks_statistic(a, b, value, by), exact_up_to)


def min_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with <c>_norm = (x - min) / (max - min) of each column, 0 where it is constant."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(ends))  # one row
    for c in cols:
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        out = out.withColumn(f"{c}_norm", F.when(span > 0, (F.col(c) - F.col(f"lo_{c}")) / span).otherwise(0.0))
    return out.drop(*[f"{n}_{c}" for c in cols for n in ("lo", "hi")])


def response_mean(df: DataFrame, outcome: str, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """(extra..., keys..., outcome): the mean outcome at each point of the other columns."""
    return df.groupBy(*(extra or []), *keys).agg(F.avg(outcome).alias(outcome))


def compare_responses(real: DataFrame, simulated: DataFrame, outcome: str, keys: list[str], by: str | list[str]) -> DataFrame:
    """(by..., n, mae, ks) for every group of simulated: response functions joined on equal keys, then error and distribution distance. Points with a null key meet none."""
    by = [by] if isinstance(by, str) else list(by)
    reserved(by, "n", "mae", "ks")
    r = response_mean(real, outcome, keys).withColumnRenamed(outcome, "__real")
    s = response_mean(simulated, outcome, keys, by).withColumnRenamed(outcome, "__sim")
    pairs = stored(s.join(r, keys).select(*by, "__real", "__sim"), "responses")
    error = pairs.groupBy(*by).agg(F.count("*").alias("n"), mae(F.col("__real"), F.col("__sim")).alias("mae"))
    one = lambda c, i, j: F.struct(F.col(c).alias("__v"), F.lit(i).alias("__a"), F.lit(j).alias("__b"))
    counts = pairs.select(*by, F.inline(F.array(one("__real", 1, 0), one("__sim", 0, 1)))).filter("__v is not null").groupBy(*by, "__v").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    ks = ks_of_counts(stored(counts, "ks-counts"), by)
    return error.join(ks.select(*by, "ks"), by)


def tradeoff(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with tradeoff = sum of the two columns' min-max norms."""
    return min_max(df, [a, b]).withColumn("tradeoff", F.col(f"{a}_norm") + F.col(f"{b}_norm"))


def histogram_counts(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """(bin, n) of explicit right-closed bins."""
    from causeway.operators.binning import cut_edges

    return df.select(cut_edges(F.col(col), edges).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def domain_summary(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """(domain, column, n, lo, q1, median, q3, hi, mean, std, distinct): what box plots and histograms of two domains are drawn from."""

    def one(df: DataFrame, name: str) -> DataFrame:
        parts = [F.struct(F.lit(c).alias("column"), F.col(f"{c}_n").alias("n"), F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_q")[0].alias("q1"), F.col(f"{c}_q")[1].alias("median"), F.col(f"{c}_q")[2].alias("q3"), F.col(f"{c}_hi").alias("hi"), F.col(f"{c}_m").alias("mean"), F.col(f"{c}_s").alias("std"), F.col(f"{c}_d").alias("distinct")) for c in cols]
        row = df.agg(*[x for c in cols for x in (F.count(c).alias(f"{c}_n"), F.min(F.col(c).cast("double")).alias(f"{c}_lo"), F.max(F.col(c).cast("double")).alias(f"{c}_hi"), F.avg(c).alias(f"{c}_m"), F.stddev_samp(c).alias(f"{c}_s"), F.countDistinct(c).alias(f"{c}_d"))])
        for c in cols:
            row = row.crossJoin(F.broadcast(exact_percentiles(df, c, [0.25, 0.5, 0.75]).withColumnRenamed("q", f"{c}_q")))  # one row each
        return row.select(F.lit(name).alias("domain"), F.inline(F.array(*parts)))

    return one(a, "a").unionByName(one(b, "b"))
