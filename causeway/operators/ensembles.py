"""Second-order boosting and staged forests: many fits grow together, a pass over the rows for each level of all their trees.

A fit is a column, not a job: settings, folds and (in forests) trees of a grid share one binned table and one aggregate a level. Tasks add gradients
and Hessians up by (fit, node, feature, bin), Spark sums those cells, and windows over a feature's bins find the best split of every node. Only
splits reach the driver, a row a node. Staged scores come from prefixes: the first k trees of a fit are the fit of k trees, and the first d levels of
a forest's trees are its trees of depth d, so a grid costs its largest settings only.

Gain of a split: (GL²/(HL+lam) + GR²/(HR+lam) - G²/(H+lam)) / 2 - gamma; a leaf's value is -G/(H+lam). Splits need a gain above 0 and Hessians of
min_child on both sides (rows, for squared loss). Equal gains: the first feature, then the lowest edge. Missing values go to the better side, to the right on a tie.
Sums are of integers (2^-20 of the target's spread), so they don't depend on order: reruns agree on any cluster. Samples of rows hash the key.

Cases: rows with a null or NaN target take no part in a fit and are predicted; null and NaN features are missing; infinite ones lie beyond all edges; a feature of
one value is never split; no row with a target raises ValueError. Nominal features become dummies without their first sorted value; unseen values are all zeros,
null ones are missing.

Scale: a task holds cells of at most about ``CELLS`` numbers (fits are dealt into blocks for that); margins of boosted fits are stored every
``every`` trees and worked out from there. Edges are percentiles of one mergeable sketch a feature, at most max_bins - 1. Rows of one fold with equal bins go the same
way in every tree, so where they are at least twice as many as their kinds, one pass adds up what the next draws make of each kind (weights and gradients, as
integers), and levels and errors meet kinds instead of rows, with the same sums. Where inputs are continuous nothing merges, and every level passes over the rows.
Where rows of equal values have at most ``KINDS`` kinds, these are counted once: edges are exact percentiles of the counts, errors meet the kinds, and rows are not stored:
a draw reads key, target and number of kind, which a broadcast join finds by hash (kinds have different hashes, or rows are binned and stored as else). df is read several
times, so its rows must not change from one time to the next. Forests of more than ``DRAWS`` trees are dealt out by draw there (and where rows are at most KINDS, each a kind):
rows are ordered by kind once, DRAWS draws are one job, and the trees of a draw grow in one task from its sums a kind, which no more rows make larger. Settings that have met the same
splits so far share their sums and gains.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.columns import nominal_columns, nominal_values
from causeway.functions.scratch import batches_by_rows, stored
from causeway.operators import stats

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package
UNIT = 2.0**-20
CELLS = 1 << 23
#: Most draws that a table of merged rows has.
DRAWS = 64
#: Most kinds of rows by value that are counted and broadcast; a draw's sums of them fill a task.
KINDS = 1 << 19
POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])
#: Poisson weights by the first 16 bits of a uniform number.
CUT = 255
SLOTS = np.searchsorted(POISSON, np.arange(1 << 16) / 65536, side="right").astype(np.uint8)
SLOTS[(POISSON * 65536).astype(np.int64)] = CUT


@dataclass(frozen=True)
class Params:
    """Settings of a fit. rows and columns: shares that a tree draws (without replacement); forests draw rows with replacement. min_split: Hessian of a node that may be split."""

    trees: int = 100
    depth: int = 6
    eta: float = 0.3
    lam: float = 1.0
    gamma: float = 0.0
    min_child: float = 1.0
    min_split: float = 0.0
    rows: float = 1.0
    columns: float = 1.0


@dataclass
class Tree:
    """Nodes in heap order (children of i: 2i+1, 2i+2); feature -1 is a leaf. Inner nodes keep their value, so a tree can be cut at any depth."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    missing_left: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = 2 ** (self.depth + 1) - 1
        self.feature, self.bin = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.missing_left, self.value = np.zeros(n, bool), np.zeros(n)

    def walk(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of every row (bins: features x rows, -1 missing) after at most ``levels`` splits."""
        node, at = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(self.depth if levels is None else min(levels, self.depth)):
            f = self.feature[node]
            b = bins[f, at]
            left = np.where(b < 0, self.missing_left[node], b <= self.bin[node])
            node = np.where(f < 0, node, 2 * node + 2 - left)
        return node


@dataclass
class Fit:
    """A tree being grown: its settings, the fold it leaves out (-1: none) and the seed of its draws."""

    params: Params
    fold: int
    seed: int
    tree: Tree | None = None

    def draw(self, forest: bool) -> tuple[int, float | None]:
        """What decides the rows that the tree sees: a seed and a share of rows; no share is a draw with replacement."""
        return (self.seed, None) if forest else (self.seed, self.params.rows) if self.params.rows < 1.0 else (0, 1.0)


def _mixed(key: np.ndarray, seed: int) -> np.ndarray:
    """64 bits from 64-bit keys and a seed, by two rounds of a mixing hash."""
    z = key.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(by)
    z ^= z >> np.uint64(31)
    return z


def uniform(key: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit keys and a seed."""
    return (_mixed(key, seed) >> np.uint64(11)).astype(np.float64) / 2.0**53


def poisson(key: np.ndarray, seed: int) -> np.ndarray:
    """How often a draw with replacement has each row: where uniform stands among POISSON. Its first 16 bits tell, but in the slots that a bound cuts."""
    z = _mixed(key, seed)
    w = SLOTS[(z >> np.uint64(48)).astype(np.int64)]
    cut = np.flatnonzero(w == CUT)
    w[cut] = np.searchsorted(POISSON, (z[cut] >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")
    return w


def _inputs(df: DataFrame, features: Sequence[str]) -> list[tuple[str, str | None]]:
    nominal = set(nominal_columns(df))
    return [(f, v) for f in features for v in (nominal_values(df, f)[1:] if f in nominal else [None])]


def _numbers(inputs: Sequence[tuple[str, str | None]]) -> list[Column]:
    """Each input as a double, null if missing."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    number = lambda c: F.when(~F.isnan(quoted(c).cast("double")), quoted(c).cast("double"))
    return [number(c) if v is None else (quoted(c) == F.lit(v)).cast("double") for c, v in inputs]


def _to_bins(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """features x rows: the place of the first edge not below the value; -1 for NaN."""
    return np.stack([np.where(np.isnan(x), -1, np.searchsorted(e, x, side="left")) for x, e in zip(columns, edges)]).astype(np.int32)


@dataclass
class Ensemble:
    """A fitted model. transform adds its prediction; trees can be cut to the first ``trees`` and to ``depth`` levels."""

    inputs: list[tuple[str, str | None]]
    edges: list[np.ndarray]
    trees: list[Tree]
    base: float
    rate: float
    objective: str
    mean: bool = False

    def predict(self, trees: int | None = None, depth: int | None = None) -> Column:
        used, edges, base, link = self.trees[:trees], self.edges, self.base, _LINKS[self.objective]
        rate = 1.0 / max(len(used), 1) if self.mean else self.rate

        def values(*columns: pd.Series) -> pd.Series:
            bins = _to_bins([c.to_numpy(np.float64) for c in columns], edges)
            return pd.Series(link(base + rate * sum((t.value[t.walk(bins, depth)] for t in used), np.zeros(bins.shape[1]))))

        return F.pandas_udf(values, "double")(*_numbers(self.inputs))

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, self.predict())


_LINKS: dict[str, Callable] = {"squared": lambda m: m, "logistic": lambda m: 1.0 / (1.0 + np.exp(-m))}


def _gradients(objective: str, origin: float, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of rows whose target is origin, and Hessians."""
    p = _LINKS[objective](margin)
    return p - origin, np.ones(len(p)) if objective == "squared" else p * (1.0 - p)


@dataclass
class _Table:
    """The binned rows with a target: key (hash), y, fold, b (bins). merges: rows of equal fold and bins are worth merging; made: merged tables and their draws.

    Rows are stored, unless there are kinds (kind: from 0 to less than n_kinds, fold, b, n_y, mean_y, dev_y); placed then has key, y and kind of every row, and is stored if it stays.
    """

    rows: DataFrame
    inputs: list[tuple[str, str | None]]
    edges: list[np.ndarray]
    base: float
    unit: float
    objective: str
    folds: int
    merges: bool
    made: list[tuple[DataFrame, list]] = field(default_factory=list)
    kinds: DataFrame | None = None
    placed: DataFrame | None = None
    n_kinds: int = 0
    stays: bool = False
    n: int = 0

    @property
    def origin(self) -> float:
        """Gradients of targets are taken from here, those of predictions up to here: their sum is the gradient."""
        return self.base if self.objective == "squared" else 0.0


def _binned(df: DataFrame, features: Sequence[str], target: str, key: str, folds: int, seed: int, objective: str, max_bins: int) -> _Table:
    if objective not in _LINKS or not 2 <= max_bins <= 1 << 15 or folds < 1 or not features:
        raise ValueError("objective is squared or logistic, max_bins from 2 to 32768, folds at least 1, and there are features")
    inputs = _inputs(df, features)
    if not inputs:
        raise ValueError("no feature has two values")
    names = [f"x_{i}" for i in range(len(inputs))]
    y = F.col("`" + target.replace("`", "``") + "`").cast("double")
    own = F.xxhash64(F.col("`" + key.replace("`", "``") + "`"))
    rows = df.select(own.alias("key"), y.alias("y"), F.pmod(F.xxhash64(own, F.lit(seed)), F.lit(folds)).cast("int").alias("fold"), *[c.alias(n) for c, n in zip(_numbers(inputs), names)]).filter(F.col("y").isNotNull() & ~F.isnan("y"))
    seen = rows.agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high")).first()
    if not seen["n"]:
        raise ValueError("no row has a target")
    if objective == "logistic" and not 0.0 <= seen["low"] <= seen["high"] <= 1.0:
        raise ValueError("a logistic target is from 0 to 1")
    rows = rows.withColumn("hash", F.xxhash64("fold", *names))
    kinds = _counted(rows, names, seen["n"])
    edges = _sketched_edges(rows, names, max_bins) if kinds is None else _counted_edges(kinds, names, max_bins)
    mean = seen["mean"]
    inner = min(max(mean, 1e-6), 1 - 1e-6)
    base = mean if objective == "squared" else float(np.log(inner / (1 - inner)))
    spread = max(seen["high"] - mean, mean - seen["low"]) if objective == "squared" else 1.0

    def binned(df: DataFrame, keep: str) -> DataFrame:
        kept = [c.split()[0] for c in keep.split(", ")]

        def bin_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins = _to_bins([b.column(n).to_numpy(zero_copy_only=False) for n in names], edges).T
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], _lists(np.ascontiguousarray(bins))], [*kept, "b"])

        return df.select(*kept, *names).mapInArrow(bin_up, f"{keep}, b array<int>")

    table, rest = binned(rows, "key long, y double, fold int"), (inputs, edges, base, (spread or 1.0) * UNIT, objective, folds)
    if kinds is not None:
        kinds = stored(binned(kinds, "kind int, hash long, fold int, n_y long, mean_y double, dev_y double"), "valued")
        placed = rows.select("key", "y", "hash").join(F.broadcast(kinds.select("hash", "kind")), "hash", "left").select("key", "y", "kind")
        return _Table(table, *rest, True, [], kinds, placed, kinds.count(), n=seen["n"])
    table = stored(table, "binned")
    n_kinds = table.agg(F.approx_count_distinct(F.xxhash64("fold", "b"))).first()[0]
    return _Table(table, *rest, 2 * n_kinds <= seen["n"], n=seen["n"])


def _counted(rows: DataFrame, names: Sequence[str], n: int) -> DataFrame | None:
    """The n rows' kinds by value (kind, hash, fold, names, n_y, mean_y, dev_y), stored; None if they are more than KINDS or than half of the rows, or if hashes don't tell them apart."""
    part = max(1, n >> 20)  # of all hashes a part is counted, to see whether rows are worth grouping
    some = rows.filter(F.pmod("hash", F.lit(part)) == 0).select("hash").distinct().limit(KINDS // part + 1).count() * part
    if some > min(KINDS, n // 2):
        return None
    cells = stored(stats.cells(rows, ["hash", "fold", *names], ["y"]), "cells")
    found = cells.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("hash").alias("hashes")).first()
    if found["n"] > min(KINDS, n // 2) or found["hashes"] < found["n"]:
        return None
    return cells.withColumn("kind", F.row_number().over(Window.orderBy("hash")) - 1)


def _sketched_edges(rows: DataFrame, names: Sequence[str], max_bins: int) -> list[np.ndarray]:
    shares = [i / max_bins for i in range(1, max_bins)]
    finite = lambda n: F.when(F.abs(n) < float("inf"), F.col(n))
    seen = rows.agg(*[F.percentile_approx(finite(n), shares, 20 * max_bins).alias(n) for n in names]).first()
    return [np.unique(np.array(seen[n] or [], np.float64)) for n in names]


def _counted_edges(kinds: DataFrame, names: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Exact percentiles at i / max_bins: the least values that so many of the rows do not pass. A window holds the values of one feature, at most KINDS."""
    counts = kinds.select("n_y", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(n).alias("x")) for i, n in enumerate(names)])).alias("v")).groupBy("v.i", "v.x").agg(F.sum("n_y").alias("n")).filter(F.abs("x") < float("inf"))
    group = Window.partitionBy("i")
    upto = counts.withColumns({"total": F.sum("n").over(group), "upto": F.sum("n").over(group.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))})
    found: dict[int, list[float]] = {}
    for r in upto.filter(f"least(upto * {max_bins} div total, {max_bins - 1}) > (upto - n) * {max_bins} div total").collect():  # at most max_bins - 1 rows a feature
        found.setdefault(r["i"], []).append(r["x"])
    return [np.unique(np.array(found.get(i, []), np.float64)) for i in range(len(names))]


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def _parts(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(fold, bins as features x rows) of a batch."""
    return batch.column("fold").to_numpy(), batch.column("b").flatten().to_numpy().reshape(batch.num_rows, features).T


def _drawn(batch: pa.RecordBatch, draws: Sequence[tuple[int, float | None]], origin: float, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """draws x rows: weights, and weighted gradients of the targets in units. Merged rows have them."""
    if "w" in batch.schema.names:
        return tuple(batch.column(c).flatten().to_numpy().reshape(batch.num_rows, len(draws)).T for c in "ws")
    w = np.stack([_weights(batch.column("key").to_numpy(), d) for d in draws])
    return w, _targets(w, batch.column("y").to_numpy(), origin, unit)


def _targets(w: np.ndarray, y: np.ndarray, origin: float, unit: float) -> np.ndarray:
    return np.rint(w * (origin - y) / unit).astype(np.int64)


def _weights(key: np.ndarray, draw: tuple[int, float | None]) -> np.ndarray:
    seed, share = draw
    if share is None:
        return poisson(key, seed).astype(np.int64)
    return np.ones(len(key), np.int64) if share >= 1.0 else (uniform(key, seed) < share).astype(np.int64)


def _kinds(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], folds: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fold, bins as rows x features, sums) with rows of equal fold and bins as one."""
    fold, bins, sums = (np.concatenate(x) for x in zip(*parts))
    code, top = fold.astype(np.int64), folds
    for b in bins.T:
        if top * width >= 1 << 62:
            code, top = np.unique(code, return_inverse=True)[1].astype(np.int64), len(code)
        code, top = code * width + b + 1, top * width
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return fold[order[first]], bins[order[first]], np.add.reduceat(sums[order], first)


def _met(t: _Table, draws: list[tuple[int, float | None]]) -> tuple[DataFrame, list[tuple[int, float | None]]]:
    """(the rows that trees meet, their draws): the table's, or a stored table with a row (fold, b, w, s: sums a draw) for all of equal fold and bins."""
    if not t.merges:
        return t.rows, draws
    for rows, known in t.made:
        if set(draws) <= set(known):
            return rows, known
    if t.kinds is not None:
        if 2 * len(draws) * t.n_kinds <= 4 * CELLS:
            return _placed(t, draws)
        t.rows, t.kinds = stored(t.rows, "binned"), None
    n, features, width, folds, origin, unit = len(draws), len(t.inputs), max(len(e) for e in t.edges) + 2, t.folds, t.origin, t.unit
    room, names = CELLS // (2 * n), [f"{c}{i}" for c in "ws" for i in range(n)]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(fold: np.ndarray, bins: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(fold), 1 << 14):
                part = slice(lo, lo + (1 << 14))
                yield pa.RecordBatch.from_arrays([pa.array(fold[part]), _lists(bins[part]), *[pa.array(x) for x in np.ascontiguousarray(sums[part].T)]], ["fold", "b", *names])

        parts, held = [], 0
        for b in batches:
            fold, bins = _parts(b, features)
            parts.append((fold, bins.T, np.concatenate(_drawn(b, draws, origin, unit)).T))
            held += b.num_rows
            if held >= room:
                parts = [_kinds(parts, folds, width)]
                held = len(parts[0][0])
                if held > room // 2:  # too many kinds to hold: Spark adds the rest up
                    yield from out(*parts[0])
                    parts, held = [], 0
        if held:
            yield from out(*_kinds(parts, folds, width))

    summed = t.rows.mapInArrow(add_up, "fold int, b array<int>, " + ", ".join(f"{c} long" for c in names)).groupBy("fold", "b").agg(*[F.sum(c).alias(c) for c in names])
    t.made.append((stored(summed.select("fold", "b", F.array(*names[:n]).alias("w"), F.array(*names[n:]).alias("s")), "kinds"), draws))
    return t.made[-1]


def _placed(t: _Table, draws: list[tuple[int, float | None]]) -> tuple[DataFrame, list[tuple[int, float | None]]]:
    """_met by number of kind: a task holds a sum for every kind and draw."""
    if t.made and not t.stays:  # more draws than one pass has
        t.placed, t.stays = stored(t.placed, "placed"), True
    n, k, origin, unit, names = len(draws), t.n_kinds, t.origin, t.unit, [f"{c}{i}" for c in "ws" for i in range(len(draws))]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, here = np.zeros((2 * n, k), np.int64), np.zeros(k, bool)

        def add(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
            key, y, kind = (np.concatenate(x) for x in zip(*parts))
            here[kind] = True
            for i, d in enumerate(draws):
                w = _weights(key, d)
                for at, v in ((i, w), (n + i, _targets(w, y, origin, unit))):
                    sums[at] += np.bincount(kind, v, k).astype(np.int64)  # whole numbers far below 2^53

        parts, rows = [], 0
        for b in batches:
            if b.column("kind").null_count:
                raise ValueError("the rows changed while they were read")
            parts.append(tuple(b.column(c).to_numpy() for c in ("key", "y", "kind")))
            rows += b.num_rows
            if rows >= max(k, 1 << 16):
                add(parts)
                parts, rows = [], 0
        if rows:
            add(parts)
        met = np.flatnonzero(here)  # undrawn ones too: later draws may have them
        for lo in range(0, len(met), 1 << 14):
            part = met[lo : lo + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[pa.array(x) for x in sums[:, part]]], ["kind", *names])

    summed = t.placed.mapInArrow(add_up, "kind int, " + ", ".join(f"{c} long" for c in names)).groupBy("kind").agg(*[F.sum(c).alias(c) for c in names])
    arrays = [F.array(*[F.sum(c) for c in part]).alias(a) for a, part in (("w", names[:n]), ("s", names[n:]))]
    with batches_by_rows(t.rows.sparkSession):
        t.made.append((stored(summed.join(t.kinds.select("kind", "fold", "b"), "kind").groupBy("fold", "b").agg(*arrays), "kinds"), draws))
    return t.made[-1]


def _margins(batch: pa.RecordBatch, bins: np.ndarray, done: list[list[Tree]], rates: Sequence[float], base: float) -> np.ndarray:
    """fits x rows: stored margins (or the base) plus the trees done since."""
    n = batch.num_rows
    out = batch.column("m").flatten().to_numpy().reshape(n, len(done)).T.copy() if "m" in batch.schema.names else np.full((len(done), n), base)
    for i, (trees, rate) in enumerate(zip(done, rates)):
        for t in trees:
            out[i] += rate * t.value[t.walk(bins)]
    return out


def _chosen(fit: Fit, features: int) -> np.ndarray:
    """The features that a tree may split, by its seed."""
    k = max(1, round(fit.params.columns * features))
    return np.arange(features) if k >= features else np.sort(np.argsort(uniform(np.arange(features), ~fit.seed), kind="stable")[:k])


def _grow(t: _Table, rows: DataFrame, draws: list[tuple[int, float | None]], fits: list[Fit], done: list[list[Tree]], forest: bool) -> None:
    """Grows a tree for every fit, level by level, on rows and their draws. done: boosted trees since the margins that are stored (none in forests, whose trees are apart)."""
    features, width = len(t.inputs), max(len(e) for e in t.edges) + 2
    for f in fits:
        f.tree = Tree(f.params.depth)
    rates, base, unit, objective, origin, drawn = [f.params.eta for f in fits], t.base, t.unit, t.objective, t.origin, [draws.index(f.draw(forest)) for f in fits]
    for level in range(max(f.params.depth for f in fits)):
        first, nodes = 2**level - 1, 2**level
        open_ = [i for i, f in enumerate(fits) if level < f.params.depth and (level == 0 or (f.tree.feature[(first - 1) // 2 : first] >= 0).any())]
        if not open_:
            break

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {i: np.zeros((2, features, nodes * width), np.int64) for i in open_}
            for b in batches:
                fold, bins = _parts(b, features)
                weights, targets = _drawn(b, draws, origin, unit)
                margins = None if forest else _margins(b, bins, done, rates, base)
                for i in open_:
                    fit, w = fits[i], weights[drawn[i]]
                    at = np.flatnonzero((w > 0) & (fold != fit.fold))
                    node = fit.tree.walk(bins[:, at], level)
                    at, node = at[node >= first], node[node >= first] - first
                    w, g = w[at], targets[drawn[i]][at]
                    if forest:
                        h = w * int(1 / UNIT)
                    else:
                        own, h = _gradients(objective, origin, margins[i][at])
                        g, h = g + w * np.rint(own / unit).astype(np.int64), w * np.rint(h / UNIT).astype(np.int64)
                    for p in _chosen(fit, features):
                        code = node * width + bins[p, at] + 1
                        for k, v in enumerate((g, h)):
                            np.add.at(sums[i][k, p], code, v)
            for i, s in sums.items():
                p, code = np.nonzero((s[0] != 0) | (s[1] != 0))
                for lo in range(0, len(p), 1 << 16):
                    a, c = p[lo : lo + (1 << 16)], code[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(a), i, np.int32), (c // width + first).astype(np.int32), a.astype(np.int32), (c % width - 1).astype(np.int32), s[0][a, c], s[1][a, c])], ["fit", "node", "feature", "bin", "g", "h"])

        summed = rows.mapInArrow(cells, "fit int, node int, feature int, bin int, g long, h long").groupBy("fit", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).repartition("fit", "node")  # one exchange for windows and maxima
        for r in best_splits(summed, [f.params for f in fits], unit).collect():  # a row a node
            tree, lam = fits[r["fit"]].tree, fits[r["fit"]].params.lam
            value = lambda g, h: -g / (h + lam) if h + lam > 0 else 0.0
            n, s = r["node"], r["split"]
            if level == 0:
                tree.value[0] = value(r["g"], r["h"])
            if s is not None and s["gain"] > 0:
                tree.feature[n], tree.bin[n], tree.missing_left[n] = -s["feature"], -s["bin"], bool(s["missing_left"])
                tree.value[2 * n + 1], tree.value[2 * n + 2] = value(s["gl"], s["hl"]), value(r["g"] - s["gl"], r["h"] - s["hl"])


def best_splits(cells: DataFrame, params: Sequence[Params], unit: float) -> DataFrame:
    """(fit, node, g, h, split) of cells (fit, node, feature, bin, g, h; bin -1 is missing): sums of the node and its best split, null if none is allowed.

    split: gain, -feature, missing_left (0, 1), -bin, gl, hl. A window holds the bins of one feature of one node.
    """
    of = lambda name: F.element_at(F.array(*[F.lit(float(getattr(p, name))) for p in params]), F.col("fit") + 1)
    group = Window.partitionBy("fit", "node", "feature")
    upto, known = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), F.col("bin") >= 0
    total = lambda c, w, keep: F.coalesce(F.sum(F.when(keep, F.col(c))).over(w), F.lit(0)) * (unit if c == "g" else UNIT)
    sums = cells.withColumns({f"{c}{part}": total(c, w, keep) for c in "gh" for part, w, keep in (("_all", group, F.lit(True)), ("_none", group, ~known), ("_left", upto, known))})
    side = lambda left: F.struct(F.lit(left).alias("missing_left"), (F.col("g_left") + left * F.col("g_none")).alias("gl"), (F.col("h_left") + left * F.col("h_none")).alias("hl"))
    # with nothing missing both sides are one split; a bin of missing values alone may also stand against all known ones
    each = sums.withColumn("s", F.explode(F.when(F.col("h_none") == 0, F.array(side(0))).otherwise(F.array(side(0), side(1)))))
    share = lambda g, h: F.when(h + of("lam") > 0, g * g / (h + of("lam"))).otherwise(0.0)
    gl, hl, g, h = F.col("s.gl"), F.col("s.hl"), F.col("g_all"), F.col("h_all")
    gain = (share(gl, hl) + share(g - gl, h - hl) - share(g, h)) / 2 - of("gamma")
    # the smallest float error is not a gain
    allowed = known & (hl >= of("min_child")) & (h - hl >= of("min_child")) & (hl > 0) & (h - hl > 0) & (h >= of("min_split")) & (gain > 1e-12 * share(g, h)) & (gain > 0)
    split = F.when(allowed, F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("s.missing_left")).alias("right_first"), (-F.col("bin")).alias("bin"), F.col("s.missing_left").alias("missing_left"), gl.alias("gl"), hl.alias("hl")))
    return each.select("fit", "node", "g_all", "h_all", split.alias("split")).groupBy("fit", "node").agg(F.max("g_all").alias("g"), F.max("h_all").alias("h"), F.max("split").alias("split"))


def _blocks(items: list, t: _Table, depth: int, most: int | None = None) -> list[list]:
    """Items in blocks, of at most ``most``, whose cells fit a task."""
    each = 2 * 2 ** max(depth - 1, 0) * len(t.inputs) * (max(len(e) for e in t.edges) + 2)
    n = max(1, min(CELLS // each, most or len(items)))
    return [items[i : i + n] for i in range(0, len(items), n)]


def _boost(t: _Table, jobs: list[tuple[Params, int]], seed: int, every: int) -> list[list[Tree]]:
    """Trees of every job (settings, fold left out)."""
    trees, done, before = [[] for _ in jobs], [[] for _ in jobs], None
    rates, base, features = [p.eta for p, _ in jobs], t.base, len(t.inputs)
    steps = [[Fit(p, fold, seed * 1_000_003 + k) for p, fold in jobs] for k in range(max(p.trees for p, _ in jobs))]
    for k, fits in enumerate(steps):
        if k % every == 0:
            rows, draws = _met(t, list(dict.fromkeys(f.draw(False) for x in steps[k : k + every] for f in x)))
            if before is not None:
                rows = stored(rows.join(before, ["fold", "b"]), "margins") if t.merges else before
        _grow(t, rows, draws, fits, done, False)
        for i, f in enumerate(fits):
            trees[i].append(f.tree)
            done[i].append(f.tree)
        if len(done[0]) == every and k + 1 < len(steps):
            since, kept = done, ["fold", "b"] if t.merges else ["key", "y", "fold", "b"]

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    m = _margins(b, _parts(b, features)[1], since, rates, base)
                    yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], _lists(np.ascontiguousarray(m.T))], [*kept, "m"])

            before = stored(rows.mapInArrow(add, ("" if t.merges else "key long, y double, ") + "fold int, b array<int>, m array<double>"), "margins")
            done = [[] for _ in jobs]
    return trees


def _sums(code: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by code, as whole numbers."""
    if np.abs(v).sum(dtype=np.float64) < 2.0**52:
        return np.bincount(code, v, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, code, v)
    return out


@dataclass
class _State:
    """What settings share that have met the same splits down to a level: the rows' nodes, and of each of the level's nodes its sums and, flat by feature, side of missing values and bin, gains and left sums."""

    node: np.ndarray
    g: np.ndarray
    h: np.ndarray
    gain: np.ndarray
    gl: np.ndarray
    hl: np.ndarray


def _state(bins: np.ndarray, node: np.ndarray, level: int, g: np.ndarray, w: np.ndarray, width: int, unit: float) -> _State:
    """As best_splits has it, without lam and gamma; gains that no split can have are -1."""
    first, nodes, features = 2**level - 1, 2**level, len(bins)
    at = np.flatnonzero(node >= first)
    code, g, w = (node[at] - first) * width, g[at], w[at]
    sums = np.stack([np.stack([_sums(code + b[at] + 1, v, nodes * width) for b in bins]) for v in (g, w)]).reshape(2, features, nodes, width).transpose(0, 2, 1, 3)
    known, upto = sums[1, :, :, 1:] > 0, np.cumsum(sums[..., 1:], axis=3)
    none, (g_all, h_all) = sums[..., 0], (sums.sum(axis=3)[..., 0] * np.array([[unit], [1.0]]))
    share = lambda g, h: np.divide(g * g, h, out=np.zeros(np.broadcast(g, h).shape), where=h > 0)
    gl, hl = (np.stack([x, x + none[i, ..., None] * u], axis=2) for i, (x, u) in enumerate(((upto[0] * unit, unit), (upto[1] * 1.0, 1.0))))
    g, h = g_all[:, None, None, None], h_all[:, None, None, None]
    gain = (share(gl, hl) + share(g - gl, h - hl) - share(g, h)) / 2
    ok = known[:, :, None] & (hl > 0) & (h - hl > 0) & (gain > 1e-12 * share(g, h)) & (gain > 0)
    ok[:, :, 1] &= (none[1] > 0)[..., None]
    return _State(node, g_all, h_all, *(x.reshape(nodes, -1) for x in (np.where(ok, gain, -1.0), gl, hl)))


def _grow_apart(fits: list[Fit], bins: np.ndarray, g: np.ndarray, w: np.ndarray, width: int, unit: float) -> None:
    """Grows forest trees that share a draw and a fold, from the draw's sums of each kind of rows: the trees that _grow makes."""
    states: dict[tuple, _State] = {}
    features, at = len(bins), np.arange(bins.shape[1])
    for f in fits:
        f.tree = tree = Tree(f.params.depth)
        mine = np.zeros((features, 2, width - 1), bool)
        mine[_chosen(f, features)] = True
        node = np.zeros(bins.shape[1], np.int64)
        for level in range(f.params.depth):
            first, nodes = 2**level - 1, 2**level
            if level and not (tree.feature[(first - 1) // 2 : first] >= 0).any():
                break
            met = (level, tree.feature[:first].tobytes(), tree.bin[:first].tobytes(), tree.missing_left[:first].tobytes())
            if met not in states:
                if level:
                    of = tree.feature[node]
                    b = bins[of, at]
                    node = np.where(of < 0, node, 2 * node + 2 - np.where(b < 0, tree.missing_left[node], b <= tree.bin[node]))
                states[met] = _state(bins, node, level, g, w, width, unit)
            s = states[met]
            node = s.node
            h = s.h[:, None]
            least = f.params.min_child
            gain = np.where((s.hl >= least) & (h - s.hl >= least) & (h >= f.params.min_split) & mine.ravel(), s.gain, -1.0)
            best = gain.argmax(axis=1)  # the first: by feature, side of missing values, bin
            value = lambda g, h: -g / h if h > 0 else 0.0
            if level == 0:
                tree.value[0] = value(s.g[0], s.h[0])
            for i in np.flatnonzero(gain[np.arange(nodes), best] > 0):
                n, (p, left, b) = first + i, np.unravel_index(best[i], mine.shape)
                tree.feature[n], tree.bin[n], tree.missing_left[n] = p, b, bool(left)
                gl, hl = s.gl[i, best[i]], s.hl[i, best[i]]
                tree.value[2 * n + 1], tree.value[2 * n + 2] = value(gl, hl), value(s.g[i] - gl, s.h[i] - hl)


def _dealt(t: _Table, jobs: list[tuple[Params, int]]) -> bool:
    """Whether forests are dealt out by draw: they have many, and a task can hold a draw's sums of all kinds."""
    few = t.n_kinds if t.kinds is not None else t.n
    cells = 2 ** max(p.depth for p, _ in jobs) * len(t.inputs) * (max(len(e) for e in t.edges) + 2)
    return max(p.trees for p, _ in jobs) > DRAWS and 0 < few <= KINDS and few * len(t.inputs) <= CELLS and 8 * cells <= CELLS


def _dealt_forests(t: _Table, jobs: list[tuple[Params, int]], seed: int) -> list[list[Tree]]:
    """_forests by draws: a job adds up DRAWS draws by kind, and the trees of a draw grow in one task."""
    if t.kinds is None:  # each row is a kind
        rows = stored(t.rows.select("key", "y", "fold", "b", (F.row_number().over(Window.orderBy("key", "y")) - 1).alias("kind")), "rows")
        t = replace(t, kinds=rows, placed=rows.select("key", "y", "kind"), n_kinds=t.n, stays=True)
    elif not t.stays:
        t.placed, t.stays = stored(t.placed.repartitionByRange("kind", "key"), "placed"), True  # a task has few kinds
    spark, k, origin, unit, width = t.rows.sparkSession, t.n_kinds, t.origin, t.unit, max(len(e) for e in t.edges) + 2
    found = t.kinds.select("kind", "fold", "b").toArrow().combine_chunks().sort_by("kind")  # at most KINDS rows
    known = spark.sparkContext.broadcast((found["fold"].to_numpy(), np.ascontiguousarray(found["b"].combine_chunks().flatten().to_numpy().reshape(k, -1).T.astype(np.int16))))
    trees: list[list[Tree]] = [[None] * p.trees for p, _ in jobs]
    most, per = max(p.trees for p, _ in jobs), max(1, min(DRAWS, 2 * CELLS // k))
    for lo in range(0, most, per):
        draws = range(lo, min(lo + per, most))

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, here = np.zeros((2, len(draws), k), np.int64), np.zeros(k, bool)

            def add(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
                key, y, kind = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(kind, kind="stable")
                key, y, kind = key[order], y[order], kind[order]
                first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
                own, off = kind[first], origin - y
                here[own] = True
                for i, d in enumerate(draws):
                    w = poisson(key, seed * 1_000_003 + d)
                    sums[0, i, own] += np.add.reduceat(w, first, dtype=np.int64)
                    sums[1, i, own] += np.add.reduceat(np.rint(w * off / unit), first).astype(np.int64)  # whole numbers far below 2^53

            parts, rows = [], 0
            for b in batches:
                if b.column("kind").null_count:
                    raise ValueError("the rows changed while they were read")
                parts.append(tuple(b.column(c).to_numpy() for c in ("key", "y", "kind")))
                rows += b.num_rows
                if rows >= 1 << 16:
                    add(parts)
                    parts, rows = [], 0
            if rows:
                add(parts)
            met = np.flatnonzero(here).astype(np.int32)
            for i, d in enumerate(draws) if len(met) else ():
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (met, sums[0, i, met], sums[1, i, met])]], ["draw", "kind", "w", "s"])

        def grow(parts: pa.Table) -> pa.Table:
            (fold, bins), sums = known.value, np.zeros((2, k), np.int64)
            for kind, w, s in zip(*(parts[c].to_pylist() for c in ("kind", "w", "s"))):
                at = np.frombuffer(kind, np.int32)
                sums[0, at] += np.frombuffer(w, np.int64)
                sums[1, at] += np.frombuffer(s, np.int64)
            d, out = parts["draw"][0].as_py(), {}
            for held in dict.fromkeys(fold for _, fold in jobs):
                own = [j for j, (p, f) in enumerate(jobs) if f == held and d < p.trees]
                fits, at = [Fit(replace(jobs[j][0], lam=0.0, gamma=0.0), held, seed * 1_000_003 + d) for j in own], np.flatnonzero((sums[0] > 0) & (fold != held))
                _grow_apart(fits, np.ascontiguousarray(bins[:, at]), sums[1, at], sums[0, at], width, unit)
                for j, f in zip(own, fits):
                    out.setdefault((f.tree.depth, *(x.tobytes() for x in (f.tree.feature, f.tree.bin, f.tree.missing_left, f.tree.value))), []).append(j)
            return pa.table({"draw": pa.array([d] * len(out), pa.int32()), "jobs": pa.array(list(out.values()), pa.list_(pa.int32())), "depth": pa.array([x[0] for x in out], pa.int32()), **{c: pa.array([x[i] for x in out], pa.binary()) for i, c in enumerate(("feature", "bin", "missing_left", "value"), 1)}})

        with batches_by_rows(spark):
            summed = t.placed.mapInArrow(add_up, "draw int, kind binary, w binary, s binary")
            for r in summed.groupBy("draw").applyInArrow(grow, "draw int, jobs array<int>, depth int, feature binary, bin binary, missing_left binary, value binary").collect():  # a row a tree
                tree = Tree(r["depth"])
                for c, kind in (("feature", np.int32), ("bin", np.int32), ("missing_left", bool), ("value", np.float64)):
                    setattr(tree, c, np.frombuffer(bytes(r[c]), kind))
                for j in r["jobs"]:
                    trees[j][r["draw"]] = tree
    known.unpersist()
    return trees


def _cut(tree: Tree, depth: int) -> Tree:
    """The first levels of a tree."""
    out = Tree(min(depth, tree.depth))
    n, inner = len(out.feature), 2**out.depth - 1
    out.bin, out.missing_left, out.value = tree.bin[:n].copy(), tree.missing_left[:n].copy(), tree.value[:n].copy()
    out.feature[:inner] = tree.feature[:inner]
    out.bin[inner:], out.missing_left[inner:] = 0, False
    return out


def _forests(t: _Table, jobs: list[tuple[Params, int]], seed: int) -> list[list[Tree]]:
    """Trees of every job. The k-th trees of all jobs share a draw and are grown together."""
    if _dealt(t, jobs):
        return _dealt_forests(t, jobs, seed)
    fits = {(j, k): Fit(replace(p, lam=0.0, gamma=0.0), fold, seed * 1_000_003 + k) for j, (p, fold) in enumerate(jobs) for k in range(p.trees)}
    for block in _blocks([fits[at] for at in sorted(fits, key=lambda at: at[::-1])], t, max(p.depth for p, _ in jobs), DRAWS if t.merges and len(jobs) == 1 else None):
        _grow(t, *_met(t, list(dict.fromkeys(f.draw(True) for f in block))), block, [], True)
    return [[fits[j, k].tree for k in range(p.trees)] for j, (p, _) in enumerate(jobs)]


def fit_boosted(df: DataFrame, features: Sequence[str], target: str, key: str, params: Params = Params(), seed: int = 42, objective: str = "squared", max_bins: int = 256, every: int = 10) -> Ensemble:
    """Boosted trees; objective 'squared', or 'logistic' for a target from 0 to 1. key names a row: it decides the draws."""
    t = _binned(df, features, target, key, 1, seed, objective, max_bins)
    return Ensemble(t.inputs, t.edges, _boost(t, [(params, -1)], seed, every)[0], t.base, params.eta, objective)


def fit_forest(df: DataFrame, features: Sequence[str], target: str, key: str, params: Params = Params(), seed: int = 42, max_bins: int = 256) -> Ensemble:
    """A random forest: every tree on its own draw of rows with replacement (Poisson weights), all trees grown together."""
    t = _binned(df, features, target, key, 1, seed, "squared", max_bins)
    return Ensemble(t.inputs, t.edges, _forests(t, [(params, -1)], seed)[0], t.base, 1.0, "squared", True)


def _staged(bins: np.ndarray, fits: Sequence[tuple[Params, list[Tree], list[tuple[int, int, int]]]], forest: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(number, predictions from the base) of every (number, trees, depth) that a fit is asked for. Trees that fits share are walked once."""
    totals = [{d: np.zeros(bins.shape[1]) for d in sorted({d for _, _, d in asked})} for _, _, asked in fits]
    for k in range(1, max((len(trees) for _, trees, _ in fits), default=0) + 1):
        met: dict[tuple[int, int], np.ndarray] = {}
        for (p, trees, asked), total in zip(fits, totals):
            if k > len(trees):
                continue
            tree = trees[k - 1]
            for d in total:
                if (id(tree), d) not in met:
                    met[id(tree), d] = tree.value[tree.walk(bins, d)]
                total[d] += met[id(tree), d]
            for i, n, d in asked:
                if n == k:
                    yield i, total[d] * (1 / k if forest else p.eta)


def staged_grid(df: DataFrame, features: Sequence[str], target: str, key: str, grid: dict[str, Sequence], kind: str = "boosted", folds: int = 3, seed: int = 42, max_bins: int = 256, every: int = 10, **fixed) -> tuple[Ensemble, DataFrame, int]:
    """(the best setting fitted on all rows, a row a setting: its values, mse, rank from 1, the number of fits it took) by cross-validation, all folds and settings together.

    grid: values by name of Params. Of 'trees' (and, in forests, 'depth') only the largest is fitted. mse is the mean of the folds that have rows; ties rank in the grid's order.
    A row's fold is a hash of its key. Base and edges are those of all rows with a target, held-out ones included.
    """
    if kind not in ("boosted", "forest") or folds < 2:
        raise ValueError("kind is boosted or forest, and there are at least 2 folds")
    t = _binned(df, features, target, key, folds, seed, "squared", max_bins)
    forest, names = kind == "forest", list(grid)
    points = [Params(**fixed, **dict(zip(names, v))) for v in itertools.product(*grid.values())]
    most, deep = max(p.trees for p in points), max(p.depth for p in points)
    whole = lambda p: replace(p, trees=most, depth=deep if forest else p.depth)
    settings = list(dict.fromkeys(map(whole, points)))
    jobs = [(p, fold) for p in settings for fold in range(folds)]
    final_too = [(p, -1) for p in settings] if forest and _dealt(t, jobs) else []  # of any setting: they share the draws' sums, which the best one would need again
    grown = _forests(t, [*jobs, *final_too], seed) if forest else [x for block in _blocks(jobs, t, deep) for x in _boost(t, block, seed, every)]
    base, width = t.base, len(t.inputs)
    wanted = [[(i, p.trees, p.depth) for i, p in enumerate(points) if whole(p) == s] for s, _ in jobs]

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(points), folds, 2))
        for b in batches:
            fold, bins = _parts(b, width)
            n_rows, mean, dev = (b.column(c).to_numpy().astype(np.float64) for c in ("n_y", "mean_y", "dev_y"))
            for held in range(folds):
                at = np.flatnonzero(fold == held)
                own = [(p, trees, asked) for (p, f), trees, asked in zip(jobs, grown, wanted) if f == held]
                for i, moved in _staged(bins[:, at], own, forest):
                    sums[i, held] += [(dev[at] + n_rows[at] * ((base + moved) - mean[at]) ** 2).sum(), n_rows[at].sum()]
        i, held = np.nonzero(sums[:, :, 1])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(held.astype(np.int32)), pa.array(sums[i, held, 0]), pa.array(sums[i, held, 1])], ["point", "fold", "sse", "n"])

    judged = t.kinds if t.kinds is not None else stored(stats.cells(t.rows, ["fold", "b"], ["y"]), "judged") if t.merges else t.rows.select("fold", "b", F.lit(1).alias("n_y"), F.col("y").alias("mean_y"), F.lit(0.0).alias("dev_y"))
    # tasks' sums are added in their own order and folds on the driver: settings with the same trees have the same error, to the bit
    total = lambda c: F.aggregate(F.array_sort(F.collect_list(c)), F.lit(0.0), lambda a, x: a + x)
    by_fold = judged.mapInArrow(errors, "point int, fold int, sse double, n double").groupBy("point", "fold").agg((total("sse") / total("n")).alias("mse"))
    found: dict[int, list[float]] = {}
    for r in by_fold.collect():  # a row a setting and fold
        found.setdefault(r["point"], []).append(r["mse"])
    mse = {i: math.fsum(v) / len(v) for i, v in found.items()}
    ranked = sorted(mse, key=lambda i: (mse[i], i))
    best = points[ranked[0]]
    scores = df.sparkSession.createDataFrame([(*[float(getattr(points[i], n)) for n in names], mse[i], r) for r, i in enumerate(ranked, 1)], ", ".join([*[f"`{n}` double" for n in names], "mse double", "rank int"]))
    if final_too:
        final = [[_cut(tree, best.depth) for tree in grown[len(jobs) + settings.index(whole(best))][: best.trees]]]
    else:
        final = _forests(t, [(best, -1)], seed) if forest else _boost(t, [(best, -1)], seed, every)
    return Ensemble(t.inputs, t.edges, final[0], t.base, best.eta, "squared", forest), scores, len(jobs)
