"""Isotonic regression of tables of any size: pool adjacent violators inside ranges of the predictor, then across their borders.

Rows are summed by distinct value first. Blocks (runs of values with one mean) are ordered by ranges; a task pools the violators of its range with a stack. Ranges of the
next round have other borders, so what violates across a border meets inside a range; rounds end when no two neighbours violate. Pooling in any order
gives the one isotonic fit, so the result is that of one sequential pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.functions.scratch import stored
from causeway.functions.windows import ranged

#: Blocks that a task pools at once.
BLOCKS = 500_000


def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One partition's blocks (lo, hi, n, s), ascending, with its violators pooled."""
    stack: list[tuple[float, float, float, float]] = []
    for batch in batches:
        for lo, hi, n, s in batch.itertuples(index=False, name=None):
            while stack and stack[-1][3] * n >= s * stack[-1][2]:
                a, _, m, t = stack.pop()
                lo, n, s = a, n + m, s + t
            stack.append((lo, hi, n, s))
    yield pd.DataFrame(stack, columns=["lo", "hi", "n", "s"], dtype="float64")


def isotonic_blocks(df: DataFrame, x: str, y: str, blocks: int = BLOCKS) -> DataFrame:
    """(lo, hi, n, mean): the runs of x on which the isotonic fit of y is constant, their rows and means, which ascend strictly. Rows with a null or NaN are left out."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    now = stored(df.select(a.alias("lo"), b.alias("y")).filter("lo is not null and y is not null and not isnan(lo) and not isnan(y)").groupBy("lo").agg(F.col("lo").alias("hi"), F.count("*").cast("double").alias("n"), F.sum("y").alias("s")), "points")
    turn = 0
    while True:
        count = now.count()
        parts = 1 if count <= blocks else -(-count // blocks) + 1 + turn % 2
        rows = now.repartitionByRange(parts, "lo").sortWithinPartitions("lo") if parts > 1 else now.coalesce(1).sortWithinPartitions("lo")
        now = stored(rows.mapInPandas(pooled, "lo double, hi double, n double, s double").withColumn("part_", F.spark_partition_id()), "blocks")
        edges = now.groupBy("part_").agg(F.min("lo").alias("lo"), F.min_by(F.col("s") / F.col("n"), "lo").alias("first"), F.max_by(F.col("s") / F.col("n"), "lo").alias("last"))
        last = F.lag("last").over(W.orderBy("lo"))  # a row a range
        if parts == 1 or edges.select((last >= F.col("first")).alias("bad")).filter("bad").isEmpty():
            return now.select("lo", "hi", F.col("n").cast("long").alias("n"), (F.col("s") / F.col("n")).alias("mean"))
        now, turn = now.drop("part_"), turn + 1


def isotonic_apply(df: DataFrame, fitted: DataFrame, x: str, out: str) -> DataFrame:
    """df with out: the fit at x; between two blocks on the line that joins their ends, beyond the ends the nearest block's mean, null where x is null or NaN or nothing was fitted.

    Distinct values of x and the ends of blocks are ordered together by ranges; the last end before and the first behind a value come from its range or from other ranges' outermost ones.
    """
    knots = fitted.select(F.inline(F.array(F.struct(F.col("lo").alias("v_"), F.struct(F.col("lo").alias("x"), F.col("mean").alias("y")).alias("k_")), F.struct(F.col("hi").alias("v_"), F.struct(F.col("hi").alias("x"), F.col("mean").alias("y")).alias("k_")))))
    asked = df.select(F.col(x).cast("double").alias("v_")).filter("v_ is not null and not isnan(v_)").distinct()
    rows = ranged(asked.join(knots.distinct(), "v_", "full"), "v_")
    w = W.partitionBy("range_").orderBy("v_")
    rows = rows.withColumns({"p_": F.last("k_", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "q_": F.first("k_", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))})
    ends = rows.groupBy("range_").agg(F.max(F.when(F.col("k_").isNotNull(), F.col("k_"))).alias("top"), F.min(F.when(F.col("k_").isNotNull(), F.col("k_"))).alias("low"))
    order = W.orderBy("range_")  # a row a range
    ends = ends.select(F.col("range_").alias("r_"), F.last("top", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("b_"), F.first("low", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("a_"))
    p, q = F.coalesce("p_", "b_"), F.coalesce("q_", "a_")
    line = p["y"] + (q["y"] - p["y"]) * (F.col("v_") - p["x"]) / (q["x"] - p["x"])
    value = F.when(p.isNull(), q["y"]).when(q.isNull() | (p["x"] == q["x"]), p["y"]).otherwise(line)
    table = rows.join(ends, F.col("range_") == F.col("r_")).select("v_", value.alias(out))
    return df.join(table, F.col(x).cast("double") == F.col("v_"), "left").drop("v_")
