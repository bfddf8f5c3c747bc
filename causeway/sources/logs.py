"""Graph logs as tables. Text is taken apart by patterns; nothing in it is ever evaluated."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = r"\(\s*'([^']*)'\s*,\s*'([^']*)'\s*\)"


def read_scored_dags(spark: SparkSession, path: str) -> DataFrame:
    """(dag_id, edges array<struct<parent, child>>, similarity, ll, aic, bic) of lines 'id: A -> B, ... | similarity_score: x | LL: x | AIC: x | BIC: x'; absent scores are null."""
    line = spark.read.text(path).filter(F.col("value").contains("->"))
    number = lambda name: F.regexp_extract("value", rf"{name}\s*:\s*(-?[0-9.]+(?:[eE][-+]?\d+)?)", 1)
    value = lambda name: F.when(number(name) != "", number(name).cast("double"))
    edges = F.transform(F.filter(F.split(F.regexp_extract("value", r"^\s*[^:]+:\s*([^|]*)", 1), ","), lambda e: e.contains("->")), lambda e: F.struct(F.trim(F.split(e, "->")[0]).alias("parent"), F.trim(F.split(e, "->")[1]).alias("child")))
    return line.select(F.trim(F.regexp_extract("value", r"^\s*([^:]+):", 1)).alias("dag_id"), edges.alias("edges"), value("similarity_score").alias("similarity"), value("LL").alias("ll"), value("AIC").alias("aic"), value("BIC").alias("bic"))


def read_dag_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(dag_id, edges, score) of blocks 'DAG n: / Edges: [(...), ...] / Score: x' (any line order of the last two)."""
    block = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^\s*(?=DAG\s+\d+)")).alias("b")).filter(F.col("b").rlike(r"^\s*DAG\s+\d+"))
    pairs = F.arrays_zip(F.regexp_extract_all("b", F.lit(PAIR), F.lit(1)).alias("parent"), F.regexp_extract_all("b", F.lit(PAIR), F.lit(2)).alias("child"))
    score = F.regexp_extract("b", r"Score[^:]*:\s*(-?[0-9.]+(?:[eE][-+]?\d+)?)", 1)
    return block.select(F.regexp_extract("b", r"DAG\s+(\d+)", 1).cast("int").alias("dag_id"), pairs.alias("edges"), F.when(score != "", score.cast("double")).alias("score"))


def edge_rows(dags: DataFrame) -> DataFrame:
    """(dag_id, parent, child)."""
    return dags.select("dag_id", F.inline("edges")).toDF("dag_id", "parent", "child")


def dag_lines(scored: DataFrame) -> DataFrame:
    """(value): the lines that read_scored_dags reads, from (dag_id, edges string 'A -> B, ...', similarity, ll, aic, bic)."""
    return scored.select(F.format_string("%s: %s | similarity_score: %.4f | LL: %.2f | AIC: %.2f | BIC: %.2f", F.col("dag_id").cast("string"), "edges", "similarity", "ll", "aic", "bic").alias("value"))


def write_json(path: str, value) -> None:
    """Small driver-side metadata (node combinations, forbidden edges) to a local file."""
    with open(path, "w") as f:
        json.dump(value, f, indent=2)


def read_json(path: str):
    with open(path) as f:
        return json.load(f)
