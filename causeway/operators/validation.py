"""A model's habits against a causal graph: effects, importance and sensitivity of all features, each from one scan, and the flags they give."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.columns import nominal_columns, nominal_values, numeric_columns
from causeway.functions.scratch import stored
from causeway.operators import stats
from causeway.operators.causal import adjusted_effect, spurious_flags
from causeway.operators.graph import Edge, feature_role, minimal_backdoor_set, nodes_of
from causeway.operators.models import shuffled_r2

Predict = Callable[[DataFrame], DataFrame]


def chosen(features: Sequence[str], value: Callable[[str], Column]) -> Column:
    """value of the feature whose number is in __f."""
    return reduce(lambda acc, jf: F.when(F.col("__f") == jf[0], value(jf[1])).otherwise(acc), enumerate(features), F.lit(None))


def placed(df: DataFrame, features: Sequence[str], value: Callable[[str], Column]) -> DataFrame:
    """df in which the feature numbered __f has another value, the rest their own."""
    kinds = dict(df.dtypes)
    return df.withColumns({f: F.when(F.col("__f") == j, value(f).cast(kinds[f])).otherwise(F.col(f)) for j, f in enumerate(features)})


def importances(df: DataFrame, predict: Predict, targets: Sequence[str], given: dict[str, list[str]] | dict[tuple[str, str], list[str]], key: str, repeats: int = 10, seed: int = 42, reads: Sequence[str] | None = None) -> DataFrame:
    """(target, feature, permutation, base_r2): the mean fall of each target's R2 when a feature is shuffled among rows of equal values of its covariates.

    given: {feature: covariates} or, where targets differ, {(target, feature): covariates} (none: among all rows). Features of one set of covariates share their orders, for
    all targets: the i-th row by key receives the values of the i-th by a seeded hash, and orders run over ranges, so a group may hold the whole table.
    reads: as in shuffled_r2. Null covariates are a value of their own. key must be unique.
    """
    each = {tf: list(z) for k, z in given.items() for tf in ([k] if isinstance(k, tuple) else [(t, k) for t in targets])}
    rows = []
    for z in dict.fromkeys(map(tuple, each.values())):
        mine = [tf for tf, own in each.items() if tuple(own) == z]
        base, after = shuffled_r2(df, predict, [t for t in targets if t in {t for t, _ in mine}], list(dict.fromkeys(f for _, f in mine)), list(z), key, repeats, seed, reads)
        rows += [(t, f, None if None in (base[t], after[t, f]) else base[t] - after[t, f], base[t]) for t, f in mine]
    return df.sparkSession.createDataFrame(rows, "target string, feature string, permutation double, base_r2 double")


def sensitivities(df: DataFrame, predict: Predict, targets: Sequence[str], features: Sequence[str], delta: float = 1.0, reads: Sequence[str] | None = None) -> DataFrame:
    """(target, feature, sensitivity): the mean change of a prediction when a feature moves by delta; all features in one scan. reads: as in shuffled_r2.

    A nominal feature of two values has them swapped; of more, every other value becomes the first and the first the second (values sorted). One of a single value doesn't move.
    """
    values = {f: nominal_values(df, f) for f in features if f in nominal_columns(df)}

    def other(f: str) -> Column:
        if f not in values:
            return F.col(f) + delta
        a, b = (values[f] * 2)[:2] if values[f] else (None, None)
        return F.when(F.col(f) == a, F.lit(b)).when(F.col(f).isNotNull(), F.lit(a))

    rows = df.groupBy(*reads).agg(F.count("*").alias("__n")) if reads else df.withColumn("__n", F.lit(1))
    each = rows.withColumn("__f", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    mean = lambda p: F.sum(p * F.col("__n")) / F.sum(F.when(p.isNotNull(), F.col("__n")))
    means = predict(placed(each, features, other)).groupBy("__f").agg(*[mean(F.col(f"p_{t}")).alias(t) for t in targets])
    means = means.select("__f", F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("m")) for t in targets])))
    base = means.filter("__f = -1").select("target", F.col("m").alias("base"))
    return means.filter("__f >= 0").join(F.broadcast(base), "target").select("target", chosen(features, F.lit).alias("feature"), (F.col("m") - F.col("base")).alias("sensitivity"))  # a row a target


def validate(df: DataFrame, dag: Iterable[Edge], targets: Sequence[str], features: Sequence[str], predict: Predict, key: str, repeats: int = 10, delta: float = 1.0, seed: int = 42, reads: Sequence[str] | None = None) -> DataFrame:
    """(target, feature, role, given, method, effect, sensitivity, permutation, effect_pct, sens_pct, perm_pct, spurious, coherent) of every feature and target.

    Effects are adjusted for the smallest backdoor set that the graph gives; importance shuffles within that set; a feature that the graph doesn't know, or that has no
    such set, is adjusted for nothing (given is null). predict adds p_<target> columns. reads: as in shuffled_r2.
    """
    dag = frozenset(dag)
    known, spark = set(nodes_of(dag)), df.sparkSession
    sets = {(t, f): minimal_backdoor_set(dag, f, t, [c for c in df.columns if c not in targets]) if {t, f} <= known else None for t in targets for f in features}
    by = list(dict.fromkeys([*(reads or ()), *features, *[c for z in sets.values() for c in z or ()]]))
    if reads and set(targets) <= set(numeric_columns(df)) - set(by):  # moments of equal rows are one row's, times their number
        clean = df.withColumns({t: F.when(~F.isnan(F.col(t).cast("double")), F.col(t)) for t in targets})
        cells = stored(stats.cells(clean, by, targets), "effects")
        effect = lambda f, t, z: adjusted_effect(cells.select(*by, F.col(f"mean_{t}").alias(t), F.col(f"n_{t}").alias("__n")), f, t, z, weight="__n")
    else:
        effect = lambda f, t, z: adjusted_effect(df, f, t, z)
    effects = reduce(DataFrame.unionByName, [effect(f, t, list(z or ())) for (t, f), z in sets.items()]).drop("n")
    roles = spark.createDataFrame([(t, f, feature_role(dag, f, t) if {t, f} <= known else "unconnected", None if z is None else ",".join(z)) for (t, f), z in sets.items()], "target string, feature string, role string, given string")
    learnt = importances(df, predict, targets, {tf: list(z or ()) for tf, z in sets.items()}, key, repeats, seed, reads).join(sensitivities(df, predict, targets, features, delta, reads), ["target", "feature"])
    flags = spurious_flags(effects, learnt.select("target", "feature", "sensitivity", "permutation"))
    return roles.join(flags, ["target", "feature"]).select("target", "feature", "role", "given", "method", "effect", "sensitivity", "permutation", "effect_pct", "sens_pct", "perm_pct", "spurious", "coherent")
