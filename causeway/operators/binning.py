"""Discretisation: bin-count rules, right-closed cuts, tail merges, first-seen codes, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.scratch import stored
from causeway.functions.windows import exact_percentiles, positions


def bin_stats(df: DataFrame, col: str) -> DataFrame:
    """One row: n_rows, n (not null), lo, hi, q1, q3 (linear interpolation)."""
    row = df.agg(F.count("*").alias("n_rows"), F.count(col).alias("n"), F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    q = exact_percentiles(df, col, [0.25, 0.75])
    return row.join(F.broadcast(q), F.lit(True), "left").select(*row.columns, F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))  # one row each


def rule_k(rule: str, h: float | None = None) -> Column:
    """Bin count by rule over the columns of bin_stats; at least 1, so a constant column has one bin."""
    n, rows = F.col("n").cast("double"), F.col("n_rows").cast("double")
    span = F.col("hi") - F.col("lo")
    width = 2 * (F.col("q3") - F.col("q1")) / F.pow(rows, F.lit(1 / 3))
    k = {
        "fixed_width": lambda: F.ceil(span / F.lit(float(h or 1))),
        "terrell_scott": lambda: F.ceil(F.pow(2 * n, F.lit(1 / 3))),
        "sqrt": lambda: F.ceil(F.sqrt(rows)),
        "rice": lambda: F.ceil(2 * F.pow(rows, F.lit(1 / 3))),
        "freedman_diaconis": lambda: F.when(width > 0, F.ceil(span / width)).otherwise(1),
        "sturges": lambda: F.ceil(F.log2(rows)) + 1,
    }[rule]()
    return F.greatest(F.coalesce(k.cast("int"), F.lit(1)), F.lit(1))


RULES = ("fixed_width", "terrell_scott", "sqrt", "rice", "freedman_diaconis", "sturges")


def edge(i: Column, lo: Column, hi: Column, k: Column) -> Column:
    """Edge i of k equal bins between lo and hi; the last is hi itself."""
    return F.when(i == k, hi).otherwise(i.cast("double") * ((hi - lo) / k) + lo)


def cut_equal(x: Column, lo: Column, hi: Column, k: Column) -> Column:
    """Code 0 to k-1 of right-closed equal bins, the lowest edge included; null outside. Rounding of the division is put right against the edges."""
    guess = F.when(hi > lo, F.ceil((x - lo) / ((hi - lo) / k)).cast("int") - 1).otherwise(F.lit(0))
    guess = F.greatest(F.lit(0), F.least(k - 1, guess))
    code = F.when(x <= edge(guess, lo, hi, k), guess - 1).when(x > edge(guess + 1, lo, hi, k), guess + 1).otherwise(guess)
    return F.when((x >= lo) & (x <= hi), F.greatest(F.lit(0), F.least(k - 1, code)).cast("int"))


def cut_edges(x: Column, edges: list[float | Column]) -> Column:
    """Code by explicit ascending edges, right-closed, the lowest included; null outside."""
    e = [F.lit(v) if not isinstance(v, Column) else v for v in edges]
    code = reduce(lambda a, b: a + b, [(x > v).cast("int") for v in e[1:-1]], F.lit(0))
    return F.when((x >= e[0]) & (x <= e[-1]), code)


def merge_tail(code: Column, first: int, into: int) -> Column:
    """Codes from first on become into."""
    return F.when(code >= first, F.lit(into)).otherwise(code)


def first_seen_codes(df: DataFrame, col: str, order: str) -> DataFrame:
    """(col, code, first), stored: codes by the smallest value of order at which each value appears, ties by value; null has none.

    Values are ordered by ranges, so no task orders them all.
    """
    seen = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.min(order).alias("__first"))
    placed = positions(seen, [], [F.col("__first"), F.col(col)], "__at")
    return stored(placed.select(col, (F.col("__at") - 1).cast("int").alias("code"), F.col("__first").alias("first")), "codes")


def bin_columns(df: DataFrame, widths: dict[str, float], suffix: str = "_bin") -> DataFrame:
    """df with a code column for each column of widths, by the fixed-width rule; one pass for all statistics, one select for all codes."""
    ends = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in widths for n, f in (("lo", F.min), ("hi", F.max))])
    for c, h in widths.items():
        ends = ends.withColumn(f"k_{c}", F.greatest(F.lit(1), F.ceil((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / F.lit(float(h))).cast("int")))
    rows = df.crossJoin(F.broadcast(ends))  # one row
    return rows.select(*df.columns, *[cut_equal(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), F.col(f"k_{c}")).alias(c + suffix) for c in widths])


def bin_report(df: DataFrame, col: str, rule: str = "fixed_width", h: float | None = None, filled: bool = True) -> DataFrame:
    """(bin, left_edge, right_edge, n): counts of each bin by rule; empty bins too if filled."""
    stats = bin_stats(df, col).withColumn("k", rule_k(rule, h)).select("lo", "hi", "k")
    codes = df.select(F.col(col).cast("double").alias("x_")).crossJoin(F.broadcast(stats))  # one row
    counts = codes.select(cut_equal(F.col("x_"), F.col("lo"), F.col("hi"), F.col("k")).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    frame = stats.select("lo", "hi", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    out = frame.join(counts, "bin", "left" if filled else "inner")
    return out.select("bin", edge(F.col("bin"), F.col("lo"), F.col("hi"), F.col("k")).alias("left_edge"), edge(F.col("bin") + 1, F.col("lo"), F.col("hi"), F.col("k")).alias("right_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def compare_rules(df: DataFrame, col: str, h: float, rules: tuple[str, ...] = RULES) -> DataFrame:
    """(rule, k, bin, n) of the non-empty bins under each rule; one statistics pass, one counting pass."""
    stats = bin_stats(df, col)
    stats = stats.select("lo", "hi", F.array(*[F.struct(F.lit(r).alias("rule"), rule_k(r, h).alias("k")) for r in rules]).alias("rules"))
    rows = df.select(F.col(col).cast("double").alias("x_")).crossJoin(F.broadcast(stats)).select("x_", "lo", "hi", F.inline("rules"))
    rows = rows.select("rule", "k", cut_equal(F.col("x_"), F.col("lo"), F.col("hi"), F.col("k")).alias("bin")).filter("bin is not null")
    return rows.groupBy("rule", "k", "bin").agg(F.count("*").alias("n"))
