"""Column-level helpers: role by type, renames, recodes, masked updates, clips, hash-based random numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """df itself; ValueError if it lacks one of cols."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def nominal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


#: Most distinct values of a nominal column that become dummies or codes.
MOST_VALUES = 10_000


def nominal_values(df: DataFrame, col: str, most: int = MOST_VALUES) -> list:
    """The distinct values, sorted, without null; ValueError if there are more than most, so no unbounded column reaches the driver."""
    values = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{col} has more than {most} distinct values")
    return sorted(values)


def common_columns(a: DataFrame, b: DataFrame, numeric: bool = True) -> list[str]:
    """Columns of both tables, in the order of the first; numeric ones only, unless told otherwise."""
    other = set(numeric_columns(b) if numeric else b.columns)
    return [c for c in (numeric_columns(a) if numeric else a.columns) if c in other]


def strip_names(df: DataFrame, suffix: str = "") -> DataFrame:
    """Column names without outer blanks and without suffix."""
    return df.toDF(*[c.strip().removesuffix(suffix) if suffix else c.strip() for c in df.columns])


def recode(col: Column, mapping: dict, otherwise: Column | None = None) -> Column:
    """mapping[value], else otherwise (the value itself, if not given)."""
    return reduce(lambda acc, kv: F.when(col == F.lit(kv[0]), F.lit(kv[1])).otherwise(acc), mapping.items(), col if otherwise is None else otherwise)


def swap_category(col: Column, a: str, b: str) -> Column:
    """a for b and b for a; anything else becomes a."""
    return F.when(col == a, F.lit(b)).otherwise(F.lit(a))


def masked(col: Column, mask: Column, value: Column) -> Column:
    """value where the mask holds; a null mask does not."""
    return F.when(F.coalesce(mask, F.lit(False)), value).otherwise(col)


def in_range(col: Column, lo: float, hi: float, closed: bool = False) -> Column:
    """lo <= x < hi, or lo <= x <= hi if closed."""
    return (col >= lo) & ((col <= hi) if closed else (col < hi))


def clip_low(col: Column, low: float = 0.0) -> Column:
    return F.when(col.isNotNull(), F.greatest(col, F.lit(low)))


def scale_by_ranges(col: Column, ranges: list[tuple[float, float, float]], closed: bool = False) -> Column:
    """x * factor in the first range (lo, hi, factor) that holds x, else x."""
    return reduce(lambda acc, r: masked(acc, in_range(col, r[0], r[1], closed), col * r[2]), reversed(ranges), col)


#: Multiplier of a 32-bit integer mix and the golden-ratio step between streams; both small enough for exact 64-bit products in any engine.
MIX, STEP, SPAN = 73244475, 2654435769, 1 << 32


def hash_uniform(key: Column, stream: int = 0) -> Column:
    """A number in [0, 1) from an integer key: shifts, exclusive ors and products modulo 2**32, so that other engines can draw the same numbers."""
    span = F.lit(SPAN).cast("long")
    h = F.pmod(F.pmod(key.cast("long"), span) + F.lit((stream + 1) * STEP % SPAN).cast("long"), span)
    for _ in range(2):
        h = F.pmod(h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(MIX).cast("long"), span)
    return h.bitwiseXOR(F.shiftright(h, 16)).cast("double") / F.lit(float(SPAN))


def hash_uniform_sql(key: str, stream: int = 0) -> str:
    """hash_uniform in the SQL of the checks."""
    h = f"(({key} + {(stream + 1) * STEP % SPAN}) % {SPAN})"
    for _ in range(2):
        h = f"((xor({h}, {h} >> 16) * {MIX}) % {SPAN})"
    return f"(xor({h}, {h} >> 16) / {float(SPAN)}::DOUBLE)"


def hash_normal(key: Column, stream: int = 0) -> Column:
    """A standard normal number from an integer key (Box and Muller)."""
    u, v = hash_uniform(key, 2 * stream + 1), hash_uniform(key, 2 * stream + 2)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * F.pi() * v)
