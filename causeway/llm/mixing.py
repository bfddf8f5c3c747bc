"""Operator 10, mixing sources to target weights: subset-sum budget fitting over document lengths.

Targets: sources in code-point order (null last) weigh 5, 2, 1 in turn and share all words; a target stops at ``cap`` times its
source, and the excess goes to the others by weight (water filling: target = min(cap * size, level * weight)). A source is taken
whole floor(target / size) times; what is left of its budget is fitted on the histogram of document lengths: each length first
gives its proportional share of documents, longest first, the rounding carried on; a bounded knapsack over the shortest documents then closes the
gap. It is the best of all subsets for sources of up to ``POOL_MAX`` words; a larger source has its budget met to the word wherever its shortest
POOL_MAX words can do it. Documents of a length are picked by a seeded hash of the id, so reruns agree.

Scale: one scan leaves (id, source, words); all else runs on counts. Histograms have one row a (source, length), so
a group is bounded by the number of distinct lengths. Picking runs over (source, length, salt), where a length with many
documents is dealt into salts of about ``unit_rows`` ids; quotas run over the salts first. Sources are placed by ranges and the level
rises by aggregates, so many sources are no group in one task either.

Cases: null or blank texts have size 0, take no words and are kept once; very long texts are counted whole; a null source is a source of its own; rows of equal
id, source and size count each and are interchangeable; equal hashes go by id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.llm.common import stored, table

WORD = r"[^\x20\x09-\x0D]+"
#: Words of the shortest documents that the knapsack starts with, and that it goes up to while a gap is left.
POOL, POOL_MAX = 1 << 16, 1 << 22


def nearest_sum(lens: list[int], limit: list[int], want: int) -> list[int]:
    """How many of each length (at most its limit) to take so that their sum is as near to want as it can be; of two as near, the smaller sum.

    Bounded knapsack by binary splitting; ``by`` tells the piece with which a sum was reached first, so one array is kept, not one a piece.
    """
    total = sum(x * m for x, m in zip(lens, limit))
    want = min(max(want, 0), total)
    by = np.full(total + 1, -1, np.int32)
    reached = np.zeros(total + 1, bool)
    reached[0] = True
    pieces: list[tuple[int, int]] = []
    top = 0
    for i, m in enumerate(limit):
        part = 1
        while m and not reached[want]:
            part = min(part, m)
            step = part * lens[i]
            new = reached[: top + 1] & ~reached[step : top + 1 + step]
            reached[step : top + 1 + step] |= new
            by[step : top + 1 + step][new] = len(pieces)
            pieces.append((i, part))
            top, m, part = top + step, m - part, part * 2
        if reached[want]:
            break
    sums = np.flatnonzero(reached)
    at = int(np.searchsorted(sums, want))
    best = min((int(sums[j]) for j in (at - 1, at) if 0 <= j < len(sums)), key=lambda x: (abs(x - want), x))
    take = [0] * len(lens)
    while best:  # a sum's piece came after all pieces of the sum without it
        i, part = pieces[by[best]]
        take[i] += part
        best -= part * lens[i]
    return take


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, pool: int = POOL, pool_max: int = POOL_MAX) -> np.ndarray:
    """How many documents of each length to take so that their words come near to budget. lengths: distinct, positive.

    Every length gets its proportional share, then a bounded knapsack over the shortest documents replaces their part by the subset sum nearest to
    what is left. It takes ``pool`` words of them and, while the budget isn't met, four times as many, up to ``pool_max`` or all documents: the
    result is the best of all subsets for a source of at most ``pool_max`` words, and beyond it for every budget that the pool can close.
    """
    order = np.argsort(lengths, kind="stable")
    lens, cnts = [int(x) for x in lengths[order]], [int(x) for x in counts[order]]
    total = sum(n * c for n, c in zip(lens, cnts))
    take = [0] * len(lens)
    if total and budget > 0:
        carry = 0
        for i in range(len(lens) - 1, -1, -1):  # exact integers: words times total
            ideal = budget * lens[i] * cnts[i] + carry
            take[i] = min(cnts[i], ideal // (lens[i] * total))
            carry = ideal - take[i] * lens[i] * total
        share = take
        while True:
            limit, used = [0] * len(lens), 0
            for i in range(len(lens)):
                limit[i] = min(cnts[i], (pool - used) // lens[i])
                used += limit[i] * lens[i]
                if limit[i] < cnts[i]:
                    break
            freed = [min(t, m) for t, m in zip(share, limit)]
            left = budget - sum(n * (t - f) for n, t, f in zip(lens, share, freed))
            found = nearest_sum(lens, limit, left)
            now = [t - f + x for t, f, x in zip(share, freed, found)]
            if abs(budget - sum(n * t for n, t in zip(lens, now))) < abs(budget - sum(n * t for n, t in zip(lens, take))) or take is share:
                take = now
            if sum(n * t for n, t in zip(lens, take)) == min(budget, total) or limit == cnts or pool >= pool_max:
                break
            pool = min(4 * pool, pool_max)
    out = np.zeros(len(lens), dtype="int64")
    out[order] = take
    return out


def positions(df: DataFrame, col: str) -> DataFrame:
    """df (a row a value of col) with ``at``, its place in code-point order from 0, null last. Ranges of values are ordered each in its own task."""
    df = stored(df.repartitionByRange(F.col(col).asc_nulls_last()).withColumn("range_", F.spark_partition_id()), "ranges")
    ahead = df.groupBy("range_").agg(F.count("*").alias("n_"))
    ahead = ahead.select("range_", F.coalesce(F.sum("n_").over(W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead_"))  # a row a partition
    own = F.row_number().over(W.partitionBy("range_").orderBy(F.col(col).asc_nulls_last()))
    return df.join(F.broadcast(ahead), "range_").withColumn("at", F.col("ahead_") + own - 1).drop("range_", "ahead_")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """sizes (source, source_size) with target and passes: min(cap * size, level * weight), the level such that targets sum to all sizes.

    The level rises in rounds, one aggregate each: sources that it would fill beyond their stop give their stop, the others share what is left.
    """
    at = F.pmod(F.col("at"), F.lit(len(weights)))
    df = positions(sizes, "source").withColumn("w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (at + 1).cast("int")))
    df = stored(df.withColumn("stop", F.col("source_size") * cap), "source-weights")
    level, full = None, -1
    while True:
        free = F.lit(True) if level is None else F.col("stop") > level * F.col("w")
        row = df.agg(F.sum("source_size").alias("all"), F.sum(F.when(~free, F.col("stop"))).alias("stopped"), F.count(F.when(~free, 1)).alias("full"), F.sum(F.when(free, F.col("w"))).alias("w")).first()
        if row["full"] == full or not row["w"]:
            break
        full, level = row["full"], (row["all"] - (row["stopped"] or 0)) / row["w"]
    target = F.least(F.col("stop").cast("double"), F.lit(float(level or 0.0)) * F.col("w"))
    df = df.withColumn("target", F.coalesce(target, F.lit(0.0)))
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    return df.select("source", "source_size", "target", passes.cast("int").alias("passes"))


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", unit_rows: int = 4096) -> DataFrame:
    """(id, size, source, source_size, target, copies) for every row of docs: how often the mix takes it."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = stored(rows, "mix-rows")
    aims = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-targets")
    counts = rows.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    plan = counts.alias("c").join(aims.alias("a"), F.col("c.source").eqNullSafe(F.col("a.source"))).select("c.source", "size", "n", "source_size", "target", "passes")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        budget = int(round(float(pdf.target.iloc[0]) - int(pdf.passes.iloc[0]) * int(pdf.source_size.iloc[0]))) if pdf.passes.iloc[0] < cap else 0
        picked = fit_lengths(pdf["size"].to_numpy(), pdf["n"].to_numpy(), budget)
        return pd.DataFrame({"source": pdf.source, "size": pdf["size"], "salts": -(-pdf["n"] // unit_rows), "picked": picked})

    plan = stored(plan.groupBy("source").applyInPandas(fit, "source string, size long, salts long, picked long"), "mix-plan")
    both = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))
    # rows of one (source, size, id) can't be told apart: they are one row with a count, so a repeated or a null id is no hot group
    alike = rows.filter("size > 0").groupBy("source", "size", "id").agg(F.count("*").alias("n"))
    dealt = alike.alias("r").join(plan.alias("p"), both("r", "p")).select("r.id", "r.source", "r.size", "r.n", F.pmod(F.xxhash64("r.id", F.lit(seed)), F.col("salts")).alias("salt"), F.xxhash64("r.id", F.lit(seed + 1)).alias("order"), "picked")
    dealt = stored(dealt, "mix-dealt")
    upto = W.partitionBy("source", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    quotas = dealt.groupBy("source", "size", "salt", "picked").agg(F.sum("n").alias("n"))
    quotas = quotas.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("n"), F.col("picked") - F.coalesce(F.sum("n").over(upto), F.lit(0))))).select("source", "size", "salt", "quota")
    dealt = dealt.alias("r").join(quotas.alias("q"), both("r", "q") & (F.col("r.salt") == F.col("q.salt"))).select("r.*", "quota")
    before = F.coalesce(F.sum("n").over(W.partitionBy("source", "size", "salt").orderBy("order", "id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = dealt.select("id", "source", "size", "n", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - before)).alias("taken"))
    parts = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / unit_rows))
    many = taken.filter(F.col("n") > unit_rows).withColumn("part", F.explode(parts)).repartition("id", "part")
    chunks = taken.filter(F.col("n") <= unit_rows).withColumn("part", F.lit(0).cast("long")).unionByName(many)
    chunks = chunks.withColumn("nth", F.explode(F.sequence(F.col("part") * unit_rows + 1, F.least(F.col("n"), (F.col("part") + 1) * unit_rows))))
    chosen = chunks.select("id", "source", "size", (F.col("nth") <= F.col("taken")).cast("int").alias("extra"))
    blank = rows.filter("size = 0").select("id", "source", "size", F.lit(0).alias("extra"))
    out = chosen.unionByName(blank).alias("r").join(aims.alias("a"), F.col("r.source").eqNullSafe(F.col("a.source")))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("extra")).otherwise(1)
    return out.select(F.col("id").alias(id_col), "size", F.col("r.source").alias("source"), "source_size", "target", copies.cast("int").alias("copies"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.when(F.col("size") > 0, F.col("copies")).otherwise(0) * F.col("size")).alias("taken"))
