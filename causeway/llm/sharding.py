"""Operator 7, sharding: Hilbert-curve order over several metadata dimensions, cut into runs of near-equal bytes.

Each document's metadata is quantised to 4 bits a dimension, text dimensions by quantiles of their values, so an outlier takes no bins from the rest. The curve
index of its cell orders the corpus, and the order is cut where a shard's share of the bytes is full. So a shard's files hold a compact box of
(lang, source, size), and filters on any of them skip files. Equal texts form a group that takes its smallest lang and source and lies in one shard:
groups up to ``large`` of a shard's bytes lie together on the curve; larger ones (at most n_shards / large) are placed first, the largest first in the emptiest
shard that has room, behind the curve's run there. Only a group that fits into no shard is cut, because sizes must stay near equal.

Scale: one scan of the texts leaves narrow keyed rows. Offsets are prefix sums in three levels (4,096 cells, 4,096 hash
ranges in a cell, units in a range), so no task orders more than a range. A group of many copies is dealt into units of about
``unit_rows`` rows by row number, so a third of all rows in one group, under one id or none, is many small windows.

Cases: a null text has no bytes (size 1, crc32 of nothing) and is grouped with the empty text; very long texts are rows like others, and one above a shard's share
fills its shard; nulls in a dimension have a bin of their own; equal (text, id) rows are interchangeable and get slots each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.llm.common import stored, table

BITS = 4
BINS = 1 << BITS


def hilbert_index(point: tuple[int, ...], bits: int = BITS) -> int:
    """Position on the Hilbert curve of a cell given by one coordinate a dimension (transposed-axes form of Skilling, 2004)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ t) >> b & 1)
    return out


def curve_table(spark: SparkSession, dims: int) -> DataFrame:
    """(cell, curve) for all BINS**dims cells; for three dimensions 4,096 rows, whatever the input."""
    cells = [tuple(c >> BITS * (dims - 1 - d) & (BINS - 1) for d in range(dims)) for c in range(BINS**dims)]
    return spark.createDataFrame([(c, hilbert_index(p)) for c, p in enumerate(cells)], "cell int, curve int")


def text_code(value: Column, low: str | None, high: str | None) -> Column:
    """A number in byte order, from the six bytes behind what the smallest and the largest value have in common; null for null."""
    a, b = (low or "").encode(), (high or "").encode()
    skip = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return F.conv(F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), skip + 1, 6)), 12, "0"), 16, 10).cast("double")


def quantile_bin(code: Column, bounds: list[float] | None) -> Column:
    """1 to 15 by how many bounds are below, 0 for null."""
    below = F.lit(1)
    for x in bounds or []:
        below = below + (code > x).cast("int")
    return F.when(code.isNull(), 0).otherwise(below)


def size_bin(size: Column) -> Column:
    """0 to 15 by half powers of two from 2**5 bytes on."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.log2(size.cast("double")) - 5) * 1.25))).cast("int")


def packed(groups: list[tuple[str, int, int]], n_shards: int, share: float) -> dict[str, int]:
    """Shards of the groups (name, bytes, rows) that fit: the largest first, in the emptiest shard."""
    load, out = [0] * n_shards, {}
    for g, size, _ in sorted(groups, key=lambda x: (-x[1], x[0])):
        k = min(range(n_shards), key=lambda i: (load[i], i))
        if load[k] + size <= share:
            out[g] = k
            load[k] += size
    return out


def shard_by_curve(docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, str] = ("lang", "source"), large: float = 0.05, unit_rows: int = 4096) -> DataFrame:
    """(id, size, text_crc32, curve, shard, slot): every row of docs, cut into n_shards runs of near-equal bytes in curve order, large groups of equal texts behind the runs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.md5(text).alias("g"),
        F.monotonically_increasing_id().alias("row"), *[F.col(c).cast("string").alias(f"d{i}") for i, c in enumerate(dims)],
    )
    rows = stored(rows, "shard-rows")
    ends = rows.agg(*[f(f"d{i}").alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("lo", F.min), ("hi", F.max))], F.sum("size").alias("bytes")).first()
    share = float(ends["bytes"] or 1) / n_shards
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.max("size").alias("size"), *[F.min(f"d{i}").alias(f"d{i}") for i in range(len(dims))])
    groups = stored(groups.select("g", "n", "size", *[text_code(F.col(f"d{i}"), ends[f"lo{i}"], ends[f"hi{i}"]).alias(f"c{i}") for i in range(len(dims))]), "shard-groups")
    at = F.array(*[F.lit(i / (BINS - 1)) for i in range(1, BINS - 1)])
    bounds = groups.agg(*[F.percentile_approx(f"c{i}", at, 10_000).alias(f"b{i}") for i in range(len(dims))]).first()
    cell = F.lit(0)
    for b in [*[quantile_bin(F.col(f"c{i}"), bounds[f"b{i}"]) for i in range(len(dims))], size_bin(F.col("size"))]:
        cell = cell * BINS + b
    g_bytes = F.col("n") * F.col("size")
    whole = groups.filter((g_bytes > large * share) & (g_bytes <= share)).select("g", g_bytes.alias("bytes"), "n").collect()  # n_shards / large rows at most
    whole = {r["g"]: (r["bytes"], r["n"]) for r in whole}
    apart = packed([(g, *x) for g, x in whole.items()], n_shards, share)
    groups = groups.withColumn("cell", cell.cast("int")).join(F.broadcast(curve_table(spark, len(dims) + 1)), "cell", "left")
    groups = groups.select("g", "curve", F.ceil(F.col("n") / unit_rows).cast("int").alias("salts"), g_bytes.alias("g_bytes"), F.col("g").isin(list(apart)).alias("apart"))
    units_of = rows.select("id", "size", "crc", "g", "row").join(groups, "g").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
    units_of = stored(units_of, "shard-units")
    units = units_of.groupBy("curve", "g", "salt", "g_bytes", "apart").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).withColumn("range", F.substring("g", 1, 3))

    def before(df: DataFrame, by: list[str], order: list[str], names: tuple[str, ...]) -> DataFrame:
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1) if by else W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumns({f"{c}_{order[-1]}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in names})

    sums, on_curve = ("bytes", "n"), units.filter(~F.col("apart"))
    ranges = on_curve.groupBy("curve", "range").agg(*[F.sum(c).alias(c) for c in sums])
    cells = before(ranges.groupBy("curve").agg(*[F.sum(c).alias(c) for c in sums]), [], ["curve"], sums).drop(*sums)
    ranges = before(ranges, ["curve"], ["range"], sums).drop(*sums)
    cut = before(on_curve, ["curve", "range"], ["g", "salt"], sums).join(ranges, ["curve", "range"]).join(F.broadcast(cells), "curve")
    start, first = F.col("bytes_curve") + F.col("bytes_range") + F.col("bytes_salt"), F.col("n_curve") + F.col("n_range") + F.col("n_salt")
    cut = cut.select("g", "salt", "g_bytes", "bytes", "n", start.alias("start"), first.alias("first"))
    cut = cut.withColumn("g_start", F.min("start").over(W.partitionBy("g")))
    middle = F.when(F.col("g_bytes") <= large * share, F.col("g_start") + F.col("g_bytes") / 2).otherwise(F.col("start") + F.col("bytes") / 2)
    shard, full = F.lit(0), 0.0
    for k in range(n_shards - 1):
        full += share - sum(whole[g][0] for g, s in apart.items() if s == k)
        shard = shard + (middle >= full).cast("int")
    cut = stored(cut.select("g", "salt", "n", "first", shard.alias("shard")), "shard-cuts")
    heads = {r["shard"]: (r["head"], r["n"]) for r in cut.groupBy("shard").agg(F.min("first").alias("head"), F.sum("n").alias("n")).collect()}
    begin, behind = [], {k: heads.get(k, (0, 0))[1] for k in range(n_shards)}
    for g, k in sorted(apart.items()):
        begin.append((g, k, behind[k]))
        behind[k] += whole[g][1]
    placed = spark.createDataFrame(begin, "g string, shard int, begin long")
    own = before(units.filter("apart"), ["g"], ["salt"], ("n",)).join(F.broadcast(placed), "g").select("g", "salt", "shard", (F.col("begin") + F.col("n_salt")).alias("first"))
    lead = F.lit(0).cast("long")
    for k, (head, _) in heads.items():
        lead = F.when(F.col("shard") == k, F.lit(head)).otherwise(lead)
    spots = stored(cut.select("g", "salt", "shard", (F.col("first") - lead).alias("first")).unionByName(own), "shard-spots")
    rank = F.row_number().over(W.partitionBy("g", "salt").orderBy("id", "row"))
    return units_of.join(spots, ["g", "salt"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "curve", "shard", (F.col("first") + rank - 1).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """One folder a shard, rows in slot order. docs must hold each id once."""
    docs.join(placed.select(id_col, "shard", "slot"), id_col).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_curve(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
