"""Table sources and sinks: CSV, Parquet, JSON, spreadsheets, globs with an id from the path, extract and rename."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.sources.sheets import read_sheets


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: .csv (header), .parquet, .json, .xlsx (the first sheet, header; needs a schema). Declare the schema where a column may look like another type; ValueError for other suffixes."""
    bare = path.rstrip("/*")
    if bare.endswith(".csv"):
        return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    if bare.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if bare.endswith(".json"):
        return spark.read.json(path, schema=schema, multiLine=True)
    if bare.endswith(".xlsx"):
        if schema is None:
            raise ValueError(f"declare the columns of {path}")
        return read_sheets(spark, path, schema)
    raise ValueError(f"unsupported file format: {path} (.csv, .parquet, .json, .xlsx)")


def write_table(df: DataFrame, path: str) -> None:
    """Overwrites path, format by suffix."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").csv(path, header=True)
    elif path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith(".json"):
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unsupported file format: {path} (.csv, .parquet, .json)")


def read_numbered(spark: SparkSession, glob: str, pattern: str, schema: str, id_col: str = "dag_id") -> DataFrame:
    """All CSV files of a glob as one table, with the number that pattern's first group finds in the file's path."""
    rows = spark.read.csv(glob, header=True, schema=schema)
    return rows.withColumn(id_col, F.regexp_extract(F.input_file_name(), pattern, 1).cast("int"))


def extract(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The mapping's columns under their new names, blanks around source names ignored."""
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.select(*[F.col(f"`{a}`").alias(b) for a, b in mapping.items()])


def union_tables(*tables: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """All rows of all tables, by column name; cols only, if given."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*cols) if cols else out
