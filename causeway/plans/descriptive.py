"""Queries on binning, columns, frequencies and metrics, each with its SQL. Line items stand for the modelling table, orders and customers for others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import columns, windows
from causeway.functions.scratch import scratch_path, small
from causeway.operators import bayes, binning, stats
from causeway.sources import tables
from causeway.sources.tables import read_table


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, f"{d}/{name}.parquet")


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def bin_fixed_width(spark, d):
    out = binning.bin_report(_read(spark, d, "lineitem"), "l_extendedprice", "fixed_width", 10000)
    return out.select("bin", _r("left_edge", 4), _r("right_edge", 4), "n")


def bin_explicit_edges(spark, d):
    o = _read(spark, d, "orders")
    top = o.agg((F.max("o_totalprice") + 1).alias("top"))
    rows = o.select("o_totalprice").crossJoin(F.broadcast(top))  # one row
    return rows.select(binning.cut_edges(F.col("o_totalprice"), [0.0, 50000.0, 100000.0, 200000.0, F.col("top")]).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def bin_rule_comparison(spark, d):
    return binning.compare_rules(_read(spark, d, "customer"), "c_acctbal", 1000)


def bin_terrell_tail_merge(spark, d):
    out = binning.bin_report(_read(spark, d, "lineitem"), "l_extendedprice", "terrell_scott", filled=False)
    return out.select(binning.merge_tail(F.col("bin"), 4, 3).alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("n"))


def factorize_first_seen(spark, d):
    o = _read(spark, d, "orders")
    codes = binning.first_seen_codes(o, "o_orderpriority", "o_orderkey")
    return o.join(small(codes), "o_orderpriority").groupBy("o_orderpriority", "code").agg(F.count("*").alias("n"))


def bin_pipeline(spark, d):
    rows = _read(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag").na.drop()
    codes = binning.first_seen_codes(rows, "l_returnflag", "l_orderkey").select("l_returnflag", F.col("code").alias("returnflag"))
    rows = binning.bin_columns(rows, {"l_quantity": 10, "l_extendedprice": 20000, "l_discount": 0.025}, "_CAT").join(small(codes), "l_returnflag")
    out = columns.strip_names(rows.select("l_quantity_CAT", "l_extendedprice_CAT", "l_discount_CAT", "returnflag"), "_CAT")
    return out.groupBy("l_quantity", "l_extendedprice", "l_discount", "returnflag").agg(F.count("*").alias("n"))


def rename_recode(spark, d):
    o = columns.require_columns(_read(spark, d, "orders"), ["o_orderstatus", "o_totalprice"]).drop("o_orderdate", "no_such_column")
    o = o.withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "priority"})
    o = o.withColumn("status", columns.recode(F.col("status"), {"F": "finished", "O": "open"}, F.lit("other")))
    return o.groupBy("status", "priority").agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("top"))


def conditional_scale_clip(spark, d):
    rows = _read(spark, d, "lineitem").select("l_linenumber", "l_quantity", "l_extendedprice")
    x = columns.scale_by_ranges(F.col("l_extendedprice"), [(0.0, 20000.0, 1.5), (20000.0, 40000.0, 0.5)])
    x = columns.masked(x, columns.in_range(F.col("l_quantity"), 10, 20, closed=True), F.lit(0.0))
    return rows.withColumn("x", columns.clip_low(x - 10000)).groupBy("l_linenumber").agg(F.round(F.avg("x"), 4).alias("mean_x"), F.sum((F.col("x") == 0).cast("long")).alias("zeros"))


def distinct_sorted_values(spark, d):
    return _read(spark, d, "lineitem").select("l_discount").distinct().orderBy("l_discount")


def empirical_joint(spark, d):
    return bayes.empirical_joint(_read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]).select("l_returnflag", "l_linestatus", "l_linenumber", "n", _r("p", 9))


def cpt_mle(spark, d):
    c = stats.contingency(_read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])
    return bayes.cpt_mle(c, "l_linenumber", ["l_returnflag", "l_linestatus"]).select("l_returnflag", "l_linestatus", "l_linenumber", "n", _r("p", 9))


def cpt_laplace(spark, d):
    o = _read(spark, d, "orders").withColumn("band", F.floor(F.col("o_totalprice") / 40000).cast("int"))
    return bayes.cpt_laplace(stats.contingency(o, ["o_orderstatus", "o_orderpriority", "band"]), "band", ["o_orderstatus", "o_orderpriority"]).select("o_orderstatus", "o_orderpriority", "band", "n", _r("p", 9))


def response_mean(spark, d):
    out = stats.response_mean(_read(spark, d, "lineitem"), "l_extendedprice", ["l_linenumber", "l_quantity"], ["l_returnflag"])
    nudged = F.round(F.col("l_extendedprice") + 1e-7, 4)  # means of eight prices in cents end in a 5 at the fifth place: the order of summation would decide
    return out.select("l_returnflag", "l_linenumber", "l_quantity", nudged.alias("l_extendedprice"))


def generator_compare(spark, d):
    rows = _read(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice")
    out = stats.compare_responses(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag <> 'R'"), "l_extendedprice", ["l_linenumber", "l_quantity"], "l_returnflag")
    return out.select("l_returnflag", "n", _r("mae", 4), _r("ks"))


def ks_two_sample(spark, d):
    rows = _read(spark, d, "lineitem").select("l_linenumber", "l_returnflag", "l_quantity")
    out = stats.ks_statistic(rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag = 'R'"), "l_quantity", ["l_linenumber"])
    return out.select("l_linenumber", _r("ks", 9), "n_a", "n_b")


def tradeoff_rank(spark, d):
    rows = _read(spark, d, "lineitem")
    g = rows.groupBy("l_linenumber").agg(F.round(F.avg("l_extendedprice"), 4).alias("mae"), F.round(F.avg("l_discount"), 9).alias("ks"))
    return windows.top_k(stats.tradeoff(g, "mae", "ks"), 3, "tradeoff", "l_linenumber").select("l_linenumber", _r("tradeoff"))


def percent_rank_avg(spark, d):
    rows = _read(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"))
    rows = rows.withColumn("v", F.when(F.col("l_linenumber") != 3, F.col("q") + F.floor(F.col("l_linenumber") / 3)))
    return windows.percent_rank_avg(rows, "v", ["l_returnflag"], "pct").select("l_returnflag", "l_linenumber", "v", _r("pct", 9))


def corr_matrix(spark, d):
    return stats.correlation_matrix(_read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("a", "b", _r("corr"))


def variance_both(spark, d):
    x, rows = F.col("l_discount"), _read(spark, d, "lineitem")
    out = rows.groupBy("l_returnflag").agg(F.round(F.var_pop(x), 9).alias("var_pop"), F.round(F.var_samp(x), 9).alias("var_samp"), F.round(F.stddev_samp(x), 9).alias("std"))
    return out.join(windows.exact_percentiles(rows, "l_quantity", [0.5], ["l_returnflag"]).select("l_returnflag", F.round(F.col("q")[0], 6).alias("median")), "l_returnflag", "left")


def numbered_files(spark, d):
    """Orders of three statuses written as numbered CSV files, read back as one table with the number in the path."""
    root = scratch_path(spark, "numbered")
    rows = _read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    for i, status in enumerate("FOP", 1):
        tables.write_table(rows.filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_totalprice"), f"{root}/sample_DAG{i}.csv")
    got = tables.read_numbered(spark, f"{root}/sample_DAG*.csv", r"DAG(\d+)", "o_orderkey long, o_totalprice double")
    return got.groupBy("dag_id").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"), F.round(F.max("o_totalprice"), 2).alias("most"))


def _predicted(spark, d):
    rows = _read(spark, d, "lineitem")
    return rows.withColumns({"y1": F.col("l_extendedprice") / 1000, "y2": F.col("l_tax"), "p1": F.col("l_quantity") * 1.5, "p2": F.col("l_discount") * 0.8})


def regression_metrics(spark, d):
    out = stats.regression_metrics(_predicted(spark, d), [("y1", "p1"), ("y2", "p2")], ["l_returnflag"])
    return out.select("l_returnflag", *[_r(c) for c in out.columns if c != "l_returnflag"])


def tolerance_metrics(spark, d):
    p = _predicted(spark, d).groupBy("l_returnflag").agg(stats.tolerance_score(F.col("y1"), F.col("p1"), 100).alias("a"), stats.tolerance_score(F.col("y2"), F.col("p2"), 0.0025).alias("b"))
    return p.select("l_returnflag", _r("a"), _r("b"), F.round((F.col("a") + F.col("b")) / 2, 6).alias("mean_score"))


def domain_comparison(spark, d):
    rows = _read(spark, d, "lineitem").select("l_linestatus", "l_quantity", "l_discount", "l_tax")
    a, b = rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'")
    out = stats.domain_summary(a, b, columns.common_columns(a, b))
    return out.select("domain", "column", "n", *[_r(c) for c in ("lo", "q1", "median", "q3", "hi", "mean", "std")], "distinct")


def histogram_counts(spark, d):
    return stats.histogram_counts(_read(spark, d, "lineitem"), "l_quantity", [0.0, 5.0, 10.0, 25.0, 40.0, 50.0])


def csv_round_trip(spark, d):
    from causeway.functions.scratch import scratch_path
    from causeway.sources.tables import union_tables, write_table

    o = _read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(spark, "orders.csv")
    write_table(o, path)
    back = read_table(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    return union_tables(back, back.filter("o_orderstatus = 'F'")).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


QUERIES = {f.__name__: f for f in (bin_fixed_width, bin_explicit_edges, bin_rule_comparison, bin_terrell_tail_merge, factorize_first_seen, bin_pipeline, rename_recode, conditional_scale_clip, distinct_sorted_values, empirical_joint, cpt_mle, cpt_laplace, response_mean, generator_compare, ks_two_sample, tradeoff_rank, percent_rank_avg, corr_matrix, variance_both, regression_metrics, tolerance_metrics, domain_comparison, histogram_counts, csv_round_trip, numbered_files)}

_CODE = "CASE WHEN {x} < {lo} OR {x} > {hi} THEN NULL WHEN {k} <= 1 THEN 0 ELSE CAST(len(list_filter(range(1, {k}), lambda i: i * (({hi} - {lo}) / {k}) + {lo} < {x})) AS INTEGER) END"


def _code(x: str, lo: str = "lo", hi: str = "hi", k: str = "k") -> str:
    return _CODE.format(x=x, lo=lo, hi=hi, k=k)


SQL = {
    "bin_fixed_width": f"""
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, greatest(1, CAST(ceil((max(l_extendedprice) - min(l_extendedprice)) / 10000) AS INTEGER)) AS k FROM lineitem),
c AS (SELECT {_code('l_extendedprice')} AS bin, count(*) AS n FROM lineitem, s GROUP BY 1),
f AS (SELECT lo, hi, k, CAST(unnest(range(k)) AS INTEGER) AS bin FROM s)
SELECT f.bin, round(bin * ((hi - lo) / k) + lo, 4) AS left_edge, round(CASE WHEN bin + 1 = k THEN hi ELSE (bin + 1) * ((hi - lo) / k) + lo END, 4) AS right_edge, coalesce(n, 0) AS n FROM f LEFT JOIN c USING (bin)""",
    "bin_explicit_edges": """
SELECT CAST(CASE WHEN o_totalprice <= 50000 THEN 0 WHEN o_totalprice <= 100000 THEN 1 WHEN o_totalprice <= 200000 THEN 2 ELSE 3 END AS INTEGER) AS bin, count(*) AS n FROM orders WHERE o_totalprice >= 0 GROUP BY 1""",
    "bin_rule_comparison": f"""
WITH s AS (SELECT count(*) AS rows, count(c_acctbal) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS iqr FROM customer),
r AS (SELECT lo, hi, unnest([
  {{'rule': 'fixed_width', 'k': ceil((hi - lo) / 1000)}}, {{'rule': 'terrell_scott', 'k': ceil(pow(2.0 * n, 1.0::DOUBLE / 3))}}, {{'rule': 'sqrt', 'k': ceil(sqrt(rows))}},
  {{'rule': 'rice', 'k': ceil(2 * pow(rows, 1.0::DOUBLE / 3))}}, {{'rule': 'freedman_diaconis', 'k': ceil((hi - lo) / (2 * iqr / pow(rows, 1.0::DOUBLE / 3)))}}, {{'rule': 'sturges', 'k': ceil(log2(rows)) + 1}}], recursive := true) FROM s),
q AS (SELECT rule, CAST(k AS INTEGER) AS k, lo, hi FROM r)
SELECT rule, k, {_code('c_acctbal')} AS bin, count(*) AS n FROM customer, q GROUP BY 1, 2, 3""",
    "bin_terrell_tail_merge": f"""
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, CAST(ceil(pow(2.0 * count(*), 1.0::DOUBLE / 3)) AS INTEGER) AS k FROM lineitem)
SELECT least(3, {_code('l_extendedprice')}) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem, s GROUP BY 1""",
    "factorize_first_seen": """
WITH f AS (SELECT o_orderpriority, min(o_orderkey) AS first FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY first, o_orderpriority) - 1 AS INTEGER) AS code, (SELECT count(*) FROM orders o WHERE o.o_orderpriority = f.o_orderpriority) AS n FROM f""",
    "bin_pipeline": f"""
WITH b AS (SELECT l_orderkey, l_quantity AS q, l_extendedprice AS e, l_discount AS t, l_returnflag AS f FROM lineitem WHERE l_orderkey IS NOT NULL AND l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL AND l_returnflag IS NOT NULL),
c AS (SELECT f, CAST(row_number() OVER (ORDER BY min(l_orderkey), f) - 1 AS INTEGER) AS code FROM b GROUP BY f),
s AS (SELECT min(q) AS ql, max(q) AS qh, CAST(ceil((max(q) - min(q)) / 10) AS INTEGER) AS qk, min(e) AS el, max(e) AS eh, CAST(ceil((max(e) - min(e)) / 20000) AS INTEGER) AS ek, min(t) AS tl, max(t) AS th, CAST(ceil((max(t) - min(t)) / 0.025::DOUBLE) AS INTEGER) AS tk FROM b)
SELECT {_code('q', 'ql', 'qh', 'qk')} AS l_quantity, {_code('e', 'el', 'eh', 'ek')} AS l_extendedprice, {_code('t', 'tl', 'th', 'tk')} AS l_discount, code AS returnflag, count(*) AS n FROM b JOIN c USING (f), s GROUP BY 1, 2, 3, 4""",
    "rename_recode": """
SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status, o_orderpriority AS priority, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1, 2""",
    "conditional_scale_clip": """
WITH a AS (SELECT l_linenumber, CASE WHEN l_quantity BETWEEN 10 AND 20 THEN 0 WHEN l_extendedprice >= 0 AND l_extendedprice < 20000 THEN l_extendedprice * 1.5::DOUBLE WHEN l_extendedprice >= 20000 AND l_extendedprice < 40000 THEN l_extendedprice * 0.5::DOUBLE ELSE l_extendedprice END - 10000 AS x FROM lineitem)
SELECT l_linenumber, round(avg(greatest(x, 0)), 4) AS mean_x, count(*) FILTER (WHERE greatest(x, 0) = 0) AS zeros FROM a GROUP BY 1""",
    "distinct_sorted_values": "SELECT DISTINCT l_discount FROM lineitem ORDER BY 1",
    "empirical_joint": "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM lineitem), 9) AS p FROM lineitem GROUP BY 1, 2, 3",
    "cpt_mle": "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY l_returnflag, l_linestatus))::DOUBLE, 9) AS p FROM lineitem GROUP BY 1, 2, 3",
    "cpt_laplace": """
WITH b AS (SELECT o_orderstatus, o_orderpriority, CAST(floor(o_totalprice / 40000) AS INTEGER) AS band FROM orders),
s AS (SELECT DISTINCT band FROM b), g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS total FROM b GROUP BY 1, 2),
c AS (SELECT o_orderstatus, o_orderpriority, band, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT g.o_orderstatus, g.o_orderpriority, s.band, coalesce(c.n, 0) AS n, round((coalesce(c.n, 0) + 1)::DOUBLE / (total + (SELECT count(*) FROM s)), 9) AS p
FROM g CROSS JOIN s LEFT JOIN c ON c.o_orderstatus = g.o_orderstatus AND c.o_orderpriority = g.o_orderpriority AND c.band = s.band""",
    "response_mean": "SELECT l_returnflag, l_linenumber, l_quantity, round(avg(l_extendedprice) + 1e-7::DOUBLE, 4) AS l_extendedprice FROM lineitem GROUP BY 1, 2, 3",
    "generator_compare": """
WITH m AS (SELECT l_returnflag, l_linenumber, l_quantity, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT s.l_returnflag, r.y AS a, s.y AS b FROM m s JOIN m r USING (l_linenumber, l_quantity) WHERE r.l_returnflag = 'R' AND s.l_returnflag <> 'R'),
u AS (SELECT l_returnflag, a AS v, 1 AS ia, 0 AS ib FROM p UNION ALL SELECT l_returnflag, b, 0, 1 FROM p),
k AS (SELECT DISTINCT l_returnflag, v, sum(ia) OVER w / sum(ia) OVER t - sum(ib) OVER w / sum(ib) OVER t AS gap FROM u WINDOW w AS (PARTITION BY l_returnflag ORDER BY v RANGE UNBOUNDED PRECEDING), t AS (PARTITION BY l_returnflag)),
e AS (SELECT l_returnflag, count(*) AS n, avg(abs(a - b)) AS mae FROM p GROUP BY 1)
SELECT l_returnflag, n, round(mae, 4) AS mae, round((SELECT max(abs(gap)) FROM k WHERE k.l_returnflag = e.l_returnflag), 6) AS ks FROM e""",
    "ks_two_sample": """
WITH u AS (SELECT l_linenumber, l_quantity AS v, CAST(l_returnflag = 'A' AS INTEGER) AS a, CAST(l_returnflag = 'R' AS INTEGER) AS b FROM lineitem WHERE l_returnflag IN ('A', 'R')),
k AS (SELECT l_linenumber, abs(sum(a) OVER w / sum(a) OVER t - sum(b) OVER w / sum(b) OVER t) AS gap, sum(a) OVER t AS n_a, sum(b) OVER t AS n_b FROM u WINDOW w AS (PARTITION BY l_linenumber ORDER BY v RANGE UNBOUNDED PRECEDING), t AS (PARTITION BY l_linenumber))
SELECT l_linenumber, round(max(gap), 9) AS ks, CAST(max(n_a) AS BIGINT) AS n_a, CAST(max(n_b) AS BIGINT) AS n_b FROM k GROUP BY 1""",
    "tradeoff_rank": """
WITH g AS (SELECT l_linenumber, round(avg(l_extendedprice), 4) AS mae, round(avg(l_discount), 9) AS ks FROM lineitem GROUP BY 1),
n AS (SELECT l_linenumber, (mae - min(mae) OVER ()) / (max(mae) OVER () - min(mae) OVER ()) + (ks - min(ks) OVER ()) / (max(ks) OVER () - min(ks) OVER ()) AS t FROM g)
SELECT l_linenumber, round(t, 6) AS tradeoff FROM n ORDER BY t, l_linenumber LIMIT 3""",
    "percent_rank_avg": """
WITH g AS (SELECT l_returnflag, l_linenumber, CASE WHEN l_linenumber <> 3 THEN max(l_quantity) + floor(l_linenumber::DOUBLE / 3) END AS v FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linenumber, v, round(CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY l_returnflag ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY l_returnflag, v) - 1)::DOUBLE / 2) / count(v) OVER (PARTITION BY l_returnflag) END, 9) AS pct FROM g""",
    "corr_matrix": "WITH c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0::DOUBLE" if a == b else f"corr({a}, {b})") + " AS c FROM lineitem" for a in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ") SELECT DISTINCT a, b, round(c, 6) AS corr FROM c",
    "variance_both": "SELECT l_returnflag, round(var_pop(l_discount), 9) AS var_pop, round(var_samp(l_discount), 9) AS var_samp, round(stddev_samp(l_discount), 9) AS std, round(median(l_quantity), 6) AS median FROM lineitem GROUP BY 1",
    "regression_metrics": """
WITH p AS (SELECT l_returnflag, l_extendedprice / 1000 AS y1, l_tax AS y2, l_quantity * 1.5::DOUBLE AS p1, l_discount * 0.8::DOUBLE AS p2 FROM lineitem),
m AS (SELECT l_returnflag, 1 - sum((y1 - p1) ** 2) / (var_pop(y1) * count(*)) AS y1_r2, avg((y1 - p1) ** 2) AS y1_mse, avg(abs(y1 - p1)) AS y1_mae, 1 - sum((y2 - p2) ** 2) / (var_pop(y2) * count(*)) AS y2_r2, avg((y2 - p2) ** 2) AS y2_mse, avg(abs(y2 - p2)) AS y2_mae FROM p GROUP BY 1)
SELECT l_returnflag, round(y1_r2, 6) AS y1_r2, round(y1_mse, 6) AS y1_mse, round(y1_mae, 6) AS y1_mae, round(y2_r2, 6) AS y2_r2, round(y2_mse, 6) AS y2_mse, round(y2_mae, 6) AS y2_mae, round((y1_r2 + y2_r2) / 2, 6) AS r2, round((y1_mse + y2_mse) / 2, 6) AS mse, round((y1_mae + y2_mae) / 2, 6) AS mae FROM m""",
    "tolerance_metrics": """
WITH m AS (SELECT l_returnflag, 1 - avg((l_extendedprice / 1000 - l_quantity * 1.5::DOUBLE) ** 2) / 100 AS a, 1 - avg((l_tax - l_discount * 0.8::DOUBLE) ** 2) / 0.0025::DOUBLE AS b FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(a, 6) AS a, round(b, 6) AS b, round((a + b) / 2, 6) AS mean_score FROM m""",
    "domain_comparison": " UNION ALL ".join(
        f"SELECT '{d}' AS domain, '{c}' AS \"column\", count({c}) AS n, round(min({c}), 6) AS lo, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS hi, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, count(DISTINCT {c}) AS \"distinct\" FROM lineitem WHERE l_linestatus = '{s}'"
        for d, s in (("a", "F"), ("b", "O")) for c in ("l_quantity", "l_discount", "l_tax")
    ),
    "histogram_counts": """
SELECT CAST(CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 25 THEN 2 WHEN l_quantity <= 40 THEN 3 ELSE 4 END AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1""",
    "numbered_files": "SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS dag_id, count(*) AS n, max(o_orderkey) AS last, round(max(o_totalprice), 2) AS most FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1",
    "csv_round_trip": "SELECT o_orderstatus, CAST(count(*) * CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS BIGINT) AS n, CAST(sum(o_custkey) * CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS BIGINT) AS keys FROM orders GROUP BY 1",
}
