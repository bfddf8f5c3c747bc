"""Running totals, ranks and exact percentiles that never order a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.functions.scratch import small, stored

#: Distinct values up to which one aggregate may hold them all.
DISTINCT = 200_000
#: Rows that a bucket of a random order holds about, and rows times draws that one job shuffles.
BUCKET, AT_ONCE = 1 << 17, 1 << 24


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """df, stored, with range_: the number of the range of the order that a row is in. Ranges hold about as many rows each; equal keys share one."""
    return stored(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranged")


def running_totals(df: DataFrame, by: str, sums: list[str], within: list[str] | None = None) -> DataFrame:
    """df with, for c in sums, cum_<c>: totals up to and including the row's value of by, and all_<c>: totals of the group, in each group of within.

    df must have one row a (within, by), that is, be aggregated already. It is ordered by ranges that Spark draws from a sample, so outliers or a large group
    don't fill a task; totals run inside a range and over the ranges of a group.
    """
    within = within or []
    rows = ranged(df, *within, by)
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*within, "range_")])
    totals = rows.groupBy(*within, "range_").agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    group = W.partitionBy(*(within or [F.lit(0)]))  # a row a range
    upto = group.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*within, "range_", *[x for c in sums for x in (F.coalesce(F.sum(f"t_{c}").over(upto), F.lit(0)).alias(f"b_{c}"), F.sum(f"t_{c}").over(group).alias(f"a_{c}"))])
    inside = W.partitionBy(*within, "range_").orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"c_{c}": F.sum(c).over(inside) for c in sums}).alias("r").join(totals.alias("t"), same("r", "t"))
    return rows.select(*[f"r.{c}" for c in df.columns], *[x for c in sums for x in ((F.col(f"c_{c}") + F.col(f"b_{c}")).alias(f"cum_{c}"), F.col(f"a_{c}").alias(f"all_{c}"))])


def positions(df: DataFrame, within: list[str], order: list[Column], out: str, size: str | None = None) -> DataFrame:
    """df with out: the place of the row in its group of within by order, from 1; size, if named, gets the rows of the group.

    One shuffle by ranges: the rows of a range are numbered as they lie sorted, and each range's share of a group starts behind those before it.
    """
    keys = {f"o{i}_": c for i, c in enumerate(order)}
    rows = df.withColumns(keys).repartitionByRange(*within, *keys).sortWithinPartitions(*within, *keys)
    rows = stored(rows.select(*df.columns, F.spark_partition_id().alias("range_"), F.monotonically_increasing_id().alias("place_")), "ordered")
    group = W.partitionBy(*(within or [F.lit(0)]))  # a row a range
    ahead = rows.groupBy(*within, "range_").agg(F.count("*").alias("n_"), F.min("place_").alias("first_"))
    before = F.coalesce(F.sum("n_").over(group.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = small(stored(ahead.select(*within, "range_", (before - F.col("first_") + 1).alias("ahead_"), F.sum("n_").over(group).alias("size_")), "ahead"))
    same = reduce(lambda x, y: x & y, [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*within, "range_")])
    return rows.alias("r").join(ahead.alias("t"), same).select(*[f"r.{c}" for c in df.columns], (F.col("place_") + F.col("ahead_")).alias(out), *([F.col("size_").alias(size)] if size else []))


def percent_rank_avg(df: DataFrame, value: str, within: list[str], out: str) -> DataFrame:
    """df with the average percent rank of value in its group: ties share the mean rank, nulls stay null and don't count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*within, value).agg(F.count("*").alias("n"))
    ranks = running_totals(counts, value, ["n"], within)
    ranks = ranks.select(*within, value, ((F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).cast("double") / F.col("all_n")).alias(out))
    return df.join(ranks, [*within, value], "left")


def percent_ranks_in_groups(df: DataFrame, values: dict[str, str], within: list[str]) -> DataFrame:
    """df with percent_rank_avg of each column of values under its new name, for groups that fit in a task (a row a feature): windows over one shuffle."""
    group, out = W.partitionBy(*within), {}
    for v, name in values.items():
        ties = F.count("*").over(W.partitionBy(*within, v))
        rank = F.rank().over(group.orderBy(F.col(v).asc_nulls_last())) + (ties - 1) / 2
        out[name] = F.when(F.col(v).isNotNull(), rank / F.count(v).over(group))
    return df.withColumns(out)


def exact_percentiles(df: DataFrame, col: str, ps: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., q array<double>): exact percentiles with linear interpolation, nulls left out; a group without values has none.

    Up to DISTINCT distinct values one aggregate holds them; beyond, values are counted, ordered by ranges, and picked by their ranks.
    """
    by, ps = by or [], [float(p) for p in ps]
    rows = df.select(*by, F.col(col).cast("double").alias("v_")).filter(F.col("v_").isNotNull())
    if (rows.agg(F.approx_count_distinct("v_")).first()[0] or 0) <= DISTINCT:
        return rows.groupBy(*by).agg(F.percentile("v_", F.array(*map(F.lit, ps))).alias("q"))
    ranks = running_totals(stored(rows.groupBy(*by, "v_").agg(F.count("*").alias("n")), "counts"), "v_", ["n"], by)
    at = [(F.col("all_n") - 1) * F.lit(p) for p in ps]
    picks = [F.min(F.when(F.col("cum_n") > f(x), F.col("v_"))).alias(f"{n}{i}") for i, x in enumerate(at) for n, f in (("lo", F.floor), ("hi", F.ceil))]
    got = ranks.groupBy(*by).agg(F.first("all_n").alias("all_n"), *picks)
    part = [x - F.floor(x) for x in at]
    return got.select(*by, F.array(*[F.col(f"lo{i}") * (1 - w) + F.col(f"hi{i}") * w for i, w in enumerate(part)]).alias("q"))


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def permuted(numbered: DataFrame, cols: Sequence[str], within: list[str], key: str, draws: Sequence[int], seed: int, draw: str) -> DataFrame:
    """numbered once for each of draws (in the column draw), with m_<c> for c in cols: the columns shuffled, all alike, among the rows of each group of within.

    numbered has at_ and size_, the place of the row by key in its group and the group's rows, as positions gives them. The i-th row by key receives the values of the i-th
    row by a hash of key and draw + seed. A group that is no task's work is cut into ranges of the hash: they are counted first, so the places that each fills are known,
    and the rows that give and those that receive meet in their bucket by one exchange. A group may hold the whole table.
    """
    each = numbered.withColumn(draw, F.explode(F.array(*map(F.lit, draws)))).withColumns({"h_": F.xxhash64(F.col(key), F.col(draw) + seed), "bits_": F.greatest(F.lit(0), F.ceil(F.log2(F.col("size_") / BUCKET)).cast("int"))})
    each = each.withColumn("bucket_", F.when(F.col("bits_") > 0, F.expr("shiftright(h_, 64 - bits_)")).otherwise(F.lit(0)).cast("long"))
    groups = [*within, draw]
    upto = F.sum("n_").over(W.partitionBy(*groups).orderBy("bucket_").rowsBetween(W.unboundedPreceding, 0))  # a row a bucket
    filled = each.filter("bits_ > 0").groupBy(*groups, "bucket_").agg(F.count("*").alias("n_")).withColumn("to_", upto).withColumn("from_", F.col("to_") - F.col("n_") + 1)
    block = lambda c: F.floor(F.col(c) / BUCKET)
    filled = small(stored(filled.select(*[F.col(c).alias(f"w{i}_") for i, c in enumerate(groups)], F.col("bucket_").alias("fills_"), "from_", "to_", F.explode(F.sequence(block("from_"), block("to_"))).alias("block_")), "filled"))
    met = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"w{i}_")) for i, c in enumerate(groups)])
    give = each.select(*groups, "bucket_", F.lit(0).alias("side_"), F.col("h_").alias("by_"), F.col("at_").alias("then_"), *[F.col(c).alias(f"m_{c}") for c in cols])
    own = [c for c in numbered.columns if c not in (*within, "at_", "size_")]
    take = each.drop("bucket_", "h_", "bits_").join(filled, met & (block("at_") == F.col("block_")) & F.col("at_").between(F.col("from_"), F.col("to_")), "left")
    take = take.select(*groups, F.coalesce("fills_", F.lit(0)).alias("bucket_"), F.lit(1).alias("side_"), F.col("at_").alias("by_"), F.lit(0).cast("long").alias("then_"), *own)
    both = give.unionByName(take, allowMissingColumns=True).repartition(*groups, "bucket_")
    both = both.withColumn("i_", F.row_number().over(W.partitionBy(*groups, "bucket_", "side_").orderBy("by_", "then_")))
    meet = W.partitionBy(*groups, "bucket_").orderBy("i_", "side_")
    return both.withColumns({f"m_{c}": F.lag(f"m_{c}").over(meet) for c in cols}).filter("side_ = 1").select(*groups, *own, *[f"m_{c}" for c in cols])


def permute_within(df: DataFrame, col: str, within: list[str], key: str, seed: int, out: str) -> DataFrame:
    """df with col shuffled among the rows of each group of within."""
    return permuted(positions(df, within, [F.col(key)], "at_", "size_"), [col], within, key, [0], seed, "__draw").withColumnRenamed(f"m_{col}", out).select(*df.columns, out)
