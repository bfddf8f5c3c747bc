"""Operator 1, benchmark decontamination: prefix-filtered set join, DataFrame functions only.

An item's windows are its runs of ``window`` words (a shorter item is one window). A window is a set of word shingles, and a document holds it
only if it holds all of them, so one shingle is a sufficient prefix: the rarest, by counts over all documents.

1. Texts are folded and split once and stored, their words joined by blanks, under row numbers.
2. One pass over their shingles leaves the occurrences of the benchmark's shingles, with place; these are counted.
3. Each window's rarest shingle is its prefix token; a window whose rarest shingle never occurs is dropped.
4. Occurrences of prefix tokens fix where their windows would start; the positional and length bounds (0 <= start, start + length <= words) leave candidates.
5. Of the documents with candidates, the item-sized runs at those places are compared with the windows, word by word; hit words are counted by place, items by
   membership.

Scale: texts are split once, and only texts with candidates are read again. Shingle hashes, prefix tokens, windows and candidates are broadcast below a checked
number of rows and bytes, else Spark joins them by shuffle (skewed joins are split by AQE). Shingle streams carry numbers only. Equal windows of many items are one window, and membership is joined at the end. What is gathered by row is
what one document holds.

Cases: null, empty or wordless texts have no words and are clean; very long texts are split whole; wordless items have no window; rows with equal or null ids are
judged each by its own text; items of equal text all count, ties in rarity go to the smaller hash; an empty benchmark leaves all documents clean; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import small, stored, table, words


def shingle_hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def shingles(texts: DataFrame, n: int) -> DataFrame:
    """(row, n_words, at, h) for every run of n words. texts: row, n_words, t (words joined by blanks)."""
    texts = texts.filter(F.col("n_words") >= n).select("row", "n_words", F.split("t", " ").alias("w"))
    runs = F.arrays_zip(*[(F.col("w") if i == 0 else F.slice("w", i + 1, F.greatest(F.size("w"), F.lit(1)))).alias(f"w{i}") for i in range(n)])
    out = texts.select("row", "n_words", F.posexplode(runs).alias("at", "run")).filter(F.col("at") <= F.col("n_words") - n)
    return out.select("row", "n_words", "at", shingle_hash([F.col(f"run.w{i}") for i in range(n)]).alias("h"))


def find_contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, item_ids array<string>) for every row of docs; item_ids sorted as strings."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.slice("w", i + 1, window))
    members = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w")).filter(F.size("w") > 0)
    members = stored(members.select(F.coalesce("item", F.lit("")).alias("item"), F.explode(runs).alias("ww")).withColumn("win", F.array_join("ww", " ")).distinct(), "windows")
    wins = stored(members.select("win", "ww").distinct().withColumn("wid", F.monotonically_increasing_id()).withColumn("n", F.least(F.size("ww"), F.lit(shingle))), "numbered-windows")
    sizes = sorted(r[0] for r in wins.select("n").distinct().collect())  # at most ``shingle`` numbers
    if not sizes:
        return docs.select(F.col(id_col), F.size(words(F.col(text_col))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"))
    texts = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"), F.monotonically_increasing_id().alias("row"))
    texts = stored(texts.select("row", "id", F.size("w").alias("n_words"), F.array_join("w", " ").alias("t")), "folded-texts")
    parts = []
    for n in sizes:
        cut = F.transform(F.sequence(F.lit(0), F.size("ww") - n), lambda j: F.struct(j.alias("off"), shingle_hash([F.get("ww", j + i) for i in range(n)]).alias("h")))  # noqa: B023
        parts.append(wins.filter(F.col("n") == n).select("wid", "n", F.size("ww").alias("len"), F.inline(cut)))
    parts = stored(reduce(DataFrame.unionByName, parts), "window-shingles")
    wanted = small(stored(parts.select("n", "h").distinct(), "wanted"))
    met = [shingles(texts, n).join(wanted.filter(F.col("n") == n), "h").select("row", "n_words", "at", "n", "h") for n in sizes]
    met = stored(reduce(DataFrame.unionByName, met), "shingles-met")
    prefix = parts.join(met.groupBy("n", "h").count(), ["n", "h"]).groupBy("wid", "len").agg(F.min(F.struct("count", "n", "h", "off")).alias("p"), F.count_distinct("off").alias("seen"), F.first("n").alias("n"))
    prefix = prefix.filter(F.col("seen") == F.col("len") - F.col("n") + 1)  # every shingle occurs
    prefix = small(stored(prefix.select("wid", "len", "p.n", "p.h", "p.off"), "prefix-tokens"))
    found = met.join(prefix, ["n", "h"]).select("row", "wid", (F.col("at") - F.col("off")).alias("start"), "n_words", "len")
    found = found.filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words"))).select("row", "wid", "start", "len").distinct()
    found = small(stored(found.groupBy("row").agg(F.collect_list(F.struct("wid", "start", "len")).alias("found")).withColumnRenamed("row", "found_row"), "candidates"))
    held = texts.select("row", F.split("t", " ").alias("w")).join(found, F.col("row") == F.col("found_row"))
    run = lambda c: F.when(c["start"] + c["len"] <= F.size("w"), F.array_join(F.slice("w", c["start"] + 1, c["len"]), " "))
    held = held.select("row", F.inline(F.transform("found", lambda c: F.struct(c["wid"].alias("wid"), c["start"].alias("start"), c["len"].alias("len"), run(c).alias("run")))))
    right = stored(held.join(small(wins.select("wid", "win")), "wid").filter("run = win").select("row", "wid", "start", "len"), "verified")
    places = F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("len") - 1)))
    hits = right.groupBy("row").agg(F.size(F.array_distinct(places)).cast("long").alias("n_hit"))
    owners = small(members.join(wins.select("win", "wid"), "win").select("wid", "item"))
    named = right.select("row", "wid").distinct().join(owners, "wid").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    judged = small(stored(hits.join(named, "row").withColumnRenamed("row", "hit_row"), "hits"))
    out = texts.select("row", "id", F.col("n_words").cast("long").alias("n_words")).join(judged, F.col("row") == F.col("hit_row"), "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(greatest(len(w) - 10, 0) + 1), lambda p: array_to_string(w[p + 1:p + 10], ' '))) AS win FROM i WHERE len(w) > 0),
spans AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, spans WHERE len(w) >= n),
occ AS (SELECT p.doc_id, p.p, p.n, x.item_id FROM pos p JOIN win x ON x.n = p.n AND x.win = array_to_string(p.w[p.p + 1:p.p + p.n], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h USING (doc_id) LEFT JOIN its t USING (doc_id)
"""
