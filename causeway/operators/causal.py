"""Interventional probabilities, average causal effects, adjusted regression, importance against causality."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.columns import STEP, hash_uniform, nominal_values
from causeway.functions.windows import percent_ranks_in_groups
from causeway.operators.stats import relative_frequency


def do_probability(counts: DataFrame, x: str, y: str, adjust: list[str]) -> DataFrame:
    """(x, y, p, coverage): P(y | do(x)) = sum over z of P(y | x, z) P(z). Strata without x are left out and not made up for; coverage is the P(z) kept.

    counts: a contingency table with n. Without adjust this is P(y | x).
    """
    cells = counts.groupBy(*adjust, x, y).agg(F.sum("n").alias("n"))
    if not adjust:
        return relative_frequency(cells, [x]).select(x, y, "p", F.lit(1.0).alias("coverage"))
    given = relative_frequency(cells, [*adjust, x], "p_y").drop("n")
    z = relative_frequency(cells.groupBy(*adjust).agg(F.sum("n").alias("n")), [], "p_z").drop("n")
    met = cells.select(*adjust, x).distinct().join(z, adjust).groupBy(x).agg(F.sum("p_z").alias("coverage"))
    out = given.join(z, adjust).groupBy(x, y).agg(F.sum(F.col("p_y") * F.col("p_z")).alias("p"))
    return out.join(met, x).select(x, y, "p", "coverage")


def average_causal_effect(p_do: DataFrame, x: str, y: str) -> DataFrame:
    """(ace): mean over x other than the smallest of E[y | do(x)] - E[y | do(smallest)]; 0 for a single x."""
    means = p_do.groupBy(x).agg(F.sum(F.col("p") * F.col(y)).alias("m"))
    row = means.agg(F.min_by("m", x).alias("ref"), F.sum("m").alias("all"), F.count("*").alias("k"))
    return row.select(F.when(F.col("k") > 1, (F.col("all") - F.col("ref")) / (F.col("k") - 1) - F.col("ref")).otherwise(0.0).alias("ace"))


def edge_effects(counts: DataFrame, dag, codes: list[str]) -> DataFrame:
    """(cause, effect, ace) of every edge, adjusted for the parents of the cause."""
    from causeway.operators.graph import parents

    parts = []
    for a, b in sorted(dag):
        p = do_probability(counts, a, b, list(parents(dag, a)))
        parts.append(average_causal_effect(p, a, b).select(F.lit(a).alias("cause"), F.lit(b).alias("effect"), "ace"))
    return reduce(DataFrame.unionByName, parts)


def dummies(df: DataFrame, col: str) -> list[tuple[str, Column]]:
    """0/1 columns of a nominal column's sorted values but the first; ValueError beyond MOST_VALUES values."""
    values = nominal_values(df, col)
    return [(f"{col}={v}", F.when(F.col(col) == v, 1.0).otherwise(0.0)) for v in values[1:]]


def adjusted_effect(df: DataFrame, x: str, y: str, adjust: list[str], min_rows: int = 30, weight: str | None = None) -> DataFrame:
    """(feature, target, effect, method, n): the OLS coefficient of x on y given adjust, from one aggregate of cross moments.

    Nominal columns become dummies without their first value; several dummies of x give the sum of their absolute coefficients. Fewer than
    min_rows complete rows give a null effect. A nominal target of two values gives the coefficient of a logistic regression of its code; one of more
    values is taken as its category code under a linear model (method says so). weight: the number of rows that a row of df stands for, with the mean of a numeric y.
    """
    rows = df.select(*dict.fromkeys([x, y, *adjust, *([weight] if weight else [])])).na.drop()
    w = F.col(weight) if weight else F.lit(1)
    nominal = {f.name for f in rows.schema if f.dataType.simpleString() == "string"}
    own = dummies(rows, x) if x in nominal else [(x, F.col(x).cast("double"))]
    rest = [t for z in adjust for t in (dummies(rows, z) if z in nominal else [(z, F.col(z).cast("double"))])]
    if y in nominal and weight:
        raise ValueError("a nominal target has no mean: give its rows")
    if y in nominal:
        values = nominal_values(rows, y)
        target = reduce(lambda acc, iv: F.when(F.col(y) == iv[1], float(iv[0])).otherwise(acc), enumerate(values), F.lit(None).cast("double"))
    else:
        target = F.col(y).cast("double")
    terms = [F.lit(1.0), *[t for _, t in own + rest]]
    k = len(terms)
    centre = rows.agg(*[(F.sum(t * w) / F.sum(w)).alias(f"m{i}") for i, t in enumerate([*terms[1:], target])]).first()
    shifted = [F.lit(1.0), *[t - F.lit(centre[i] or 0.0) for i, t in enumerate(terms[1:])]]
    shifted_y = target - F.lit(centre[k - 1] or 0.0)
    moments = rows.agg(F.coalesce(F.sum(w), F.lit(0)).cast("long").alias("n"), *[F.sum(shifted[i] * shifted[j] * w).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(shifted[i] * shifted_y * w).alias(f"y{i}") for i in range(k)]).first()
    spark = df.sparkSession
    schema = "feature string, target string, effect double, method string, n long"
    if moments["n"] < min_rows or not own:
        return spark.createDataFrame([(x, y, None, "insufficient_data", moments["n"])], schema)
    a = np.array([[moments[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.linalg.lstsq(a, np.array([moments[f"y{i}"] for i in range(k)]), rcond=None)[0][1 : 1 + len(own)]
    method = "linear_probability" if y in nominal else "ols"
    if y in nominal and len(values) == 2:
        b, method = logit_coefficients(rows, [t for _, t in own + rest], target)[: len(own)], "logit"
    effect = float(b[0]) if len(own) == 1 else float(np.abs(b).sum())
    return spark.createDataFrame([(x, y, effect, method, moments["n"])], schema)


def logit_coefficients(rows: DataFrame, terms: list[Column], target: Column) -> np.ndarray:
    """Coefficients of the terms in an unpenalised logistic regression of a 0/1 target."""
    names = [f"x{i}_" for i in range(len(terms))]
    data = VectorAssembler(inputCols=names, outputCol="x_").transform(rows.select(target.alias("y_"), *[t.alias(n) for t, n in zip(terms, names)]))
    return LogisticRegression(featuresCol="x_", labelCol="y_", maxIter=100, tol=1e-9).fit(data).coefficients.toArray()


#: Where the cumulative distribution of a Poisson weight of mean 1 stands, up to a tail of 1e-9.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def poisson_weight(u: Column) -> Column:
    """A Poisson number of mean 1 from a uniform one: how often a bootstrap draws the row."""
    return reduce(lambda a, b: a + b, [(u >= F.lit(c)).cast("int") for c in POISSON])


def stratified_effect(df: DataFrame, x: str, y: str, strata: list[str], key: str, replicates: int = 32, level: float = 0.95) -> DataFrame:
    """(feature, target, effect, low, high, se, n, coverage): g-computation over strata, with a Poisson bootstrap in the same pass.

    A numeric x: the change of the mean outcome if every row's x were one more, under a linear model with an intercept a stratum; that is the pooled slope
    within strata, and the coefficient that adjusted_effect finds for nominal strata. A nominal x of two values: the mean outcome if all rows had the
    larger value, less that if all had the smaller, strata weighted by their rows. coverage: the share of rows in strata that tell anything about
    x; the others are left out and not made up for. Rows with a null or NaN are left out; the bootstrap's weights follow from an integer key and can be repeated.

    The data is read once: a replicate is a number beside the stratum, and rows with their weights become sums map-side, so what shuffles is a row a stratum, replicate and task.
    """
    rows = df.select(F.col(key).cast("long").alias("__key"), F.col(x).alias("__x"), F.col(y).cast("double").alias("__y"), *[F.col(z).alias(f"__z{i}") for i, z in enumerate(strata)]).na.drop()
    nominal = dict(df.dtypes)[x] == "string"
    if nominal:
        values = nominal_values(rows, "__x", 2)
        if len(values) != 2:
            raise ValueError(f"{x} must have two values")
        rows = rows.withColumn("__x", (F.col("__x") == values[1]).cast("double"))
    middle = rows.agg(F.avg("__x").alias("x"), F.avg("__y").alias("y")).first()
    shift = (0.0, 0.0) if nominal or middle["x"] is None else (middle["x"], middle["y"])
    rows = rows.withColumns({"__x": F.col("__x").cast("double") - shift[0], "__y": F.col("__y") - shift[1]})
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("__u", hash_uniform(F.col("__key") + F.col("b") * F.lit(STEP)))
    w = F.when(F.col("b") == 0, 1).otherwise(poisson_weight(F.col("__u")))
    rows = rows.withColumn("__w", w)  # no filter on it: pushed down, it would work the hash out once for every step of the distribution
    sums = {"w": F.col("__w"), "x": F.col("__w") * F.col("__x"), "y": F.col("__w") * F.col("__y"), "xx": F.col("__w") * F.col("__x") * F.col("__x"), "xy": F.col("__w") * F.col("__x") * F.col("__y")}
    cells = rows.groupBy("b", *[f"__z{i}" for i in range(len(strata))]).agg(*[F.sum(v).cast("double").alias(n) for n, v in sums.items()])
    w, sx, sy, sxx, sxy = (F.col(n) for n in sums)
    if nominal:  # x is 0 or 1: sx counts ones, sxy sums their outcomes
        tells = (sx > 0) & (sx < w)
        top, bottom = w * (sxy / F.nullif(sx, F.lit(0.0)) - (sy - sxy) / F.nullif(w - sx, F.lit(0.0))), w
    else:
        tells = sxx - sx * sx / w > 1e-12 * F.greatest(sxx, F.lit(1e-300))
        top, bottom = sxy - sx * sy / w, sxx - sx * sx / w
    found = cells.groupBy("b").agg(F.sum(F.when(tells, top)).alias("top"), F.sum(F.when(tells, bottom)).alias("bottom"), F.coalesce(F.sum(F.when(tells, w)), F.lit(0.0)).alias("told"), F.sum("w").alias("w"))
    found = found.select("b", (F.col("top") / F.nullif("bottom", F.lit(0.0))).alias("e"), "told", "w")
    again = F.when(F.col("b") > 0, F.col("e"))
    tail = (1 - level) / 2
    out = found.agg(F.max(F.when(F.col("b") == 0, F.col("e"))).alias("effect"), F.percentile(again, tail).alias("low"), F.percentile(again, 1 - tail).alias("high"), F.stddev_samp(again).alias("se"), F.coalesce(F.max(F.when(F.col("b") == 0, F.col("w"))), F.lit(0.0)).cast("long").alias("n"), F.max(F.when(F.col("b") == 0, F.col("told") / F.nullif("w", F.lit(0.0)))).alias("coverage"))
    return out.select(F.lit(x).alias("feature"), F.lit(y).alias("target"), "effect", "low", "high", "se", "n", "coverage")


def spurious_flags(effects: DataFrame, importance: DataFrame, weak: float = 0.40, strong: float = 0.60) -> DataFrame:
    """Outer join on (target, feature) with average percent ranks in the target and the flags.

    effects: target, feature, effect; importance: target, feature, sensitivity, permutation. spurious: a weak causal effect with a strong
    importance; coherent: effect and sensitivity of one sign.
    """
    rows = effects.join(importance, ["target", "feature"], "full").withColumns({"effect_abs": F.abs("effect"), "sens_abs": F.abs("sensitivity"), "perm_abs": F.abs("permutation")})
    rows = percent_ranks_in_groups(rows, {"effect_abs": "effect_pct", "sens_abs": "sens_pct", "perm_abs": "perm_pct"}, ["target"])
    flag = (F.col("effect_pct") <= weak) & ((F.col("sens_pct") >= strong) | (F.col("perm_pct") >= strong))
    sign = F.col("effect") * F.col("sensitivity") > 0
    return rows.withColumns({"spurious": F.coalesce(flag, F.lit(False)), "coherent": F.coalesce(sign, F.lit(False))})
