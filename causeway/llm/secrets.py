"""Operator 4, secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions and pyspark.ml only.

Candidates are runs of at least 16 key characters. Features: length, character-class transitions, shares of digits, capitals and hex digits, distinct
characters, dictionary coverage (share of the candidate's letter trigrams that are common in the corpus's words), the neighbouring words (words that
announce secrets, harmless digests or placeholders; assignment and quotes; and the probability that a logistic regression over
the nearest words, hashed to NEAR_SLOTS slots, gives, so it is learnt which of them matter) and the path (test or example places). A random forest is trained on labelled
findings, at most ``max_rows`` of them, and scores all candidates.

Scale: one map over the texts; only texts with a candidate are marked and split, in linear time. Words of all texts are counted (combined map-side), then their
trigrams; a table of letter trigrams has 26**3 rows at most, whatever the input, and the common ones become a hash set in the plan.

Cases: null and empty texts have no candidate; very long texts are searched whole; findings of one candidate and left side are one order in the sample, so which of them train is no matter; repeated candidates are findings each, numbered from 1 in a text; a null path has no marks; without
labels of both kinds the score is the share of label 1, or one half without any label; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import fold, hashed_sample, small, stored, table

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
ANNOUNCE = r"(?i)passw|passwd|pwd|secret|token|api_?key|access_?key|auth|credential|bearer|private"
HARMLESS = r"(?i)\bsha\d*|hash|checksum|digest|uuid|commit|etag|md5|integrity|\bid\b"
PLACEHOLDER = r"(?i)example|dummy|sample|changeme|fake|placeholder|xxxx|your[_-]|abcdef|123456"
PLACE = r"(?i)test|example|sample|spec|fixture|mock|docs?/"
#: What stands right in front of an announced value.
ANNOUNCED = r"(?i)(passw(or)?d|passphrase|pwd|secret|token|key|credentials?)[\"']?\s*(:=|=>|[=:])\s*[\"']?$|\bbearer\s+$"
ISSUED = (
    r"^(A[KS]IA[0-9A-Z]{12,}|gh[pousr]_[0-9A-Za-z]{30,}|github_pat_[0-9A-Za-z_]{20,}|glpat-[0-9A-Za-z_\-]{16,}|sk-[0-9A-Za-z]{20,}|sk-(proj|ant|svcacct)-[0-9A-Za-z_\-]{20,}"
    r"|[sr]k_(live|test)_[0-9A-Za-z]{16,}|xox[abp]-[0-9A-Za-z\-]{10,}|AIza[0-9A-Za-z_\-]{30,}|eyJ[0-9A-Za-z_\-]{13,})"
)
#: In front of the payload or the signature of a web token.
WEB_TOKEN = r"\beyJ[0-9A-Za-z_\-]+\.([0-9A-Za-z_\-]+\.)?$"
WORDS = r"[A-Za-z][a-z]{3,}|[A-Z]{5,}"
#: Slots that the nearest words, four in front of a candidate and two behind, are hashed to.
NEAR_SLOTS = 4096
FEATURES = ["length", "transitions", "digits", "capitals", "hex", "distinct", "coverage", "announced", "harmless", "placeholder", "assigned", "quoted", "place"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, path, nth, left, candidate, right): every candidate with the up to 48 characters in front of it, other candidates included, and up to 24 behind it, as far as the next."""
    text = F.translate(F.col(text_col), "\u0001", " ")
    rows = docs.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), text.alias("text")).filter(F.col("text").rlike(CANDIDATE))
    rows = rows.select("id", "path", F.split(F.regexp_replace("text", f"({CANDIDATE})", "\u0001$1\u0001"), "\u0001").alias("parts"))
    # a candidate has 16 characters at least, so three with the gaps in front of them fill 48
    left = lambda i: F.right(F.concat(*[F.coalesce(F.right(F.get("parts", i - k), F.lit(48)), F.lit("")) for k in range(6, 0, -1)]), F.lit(48))
    near = F.transform(F.sequence(F.lit(1), F.size("parts") - 2, F.lit(2)), lambda i: F.struct(((i + 1) / 2).cast("int").alias("nth"), left(i).alias("left"), F.get("parts", i).alias("candidate"), F.left(F.get("parts", i + 1), F.lit(24)).alias("right")))
    return rows.select("id", "path", F.inline(near))


def common_trigrams(docs: DataFrame, text_col: str = "text") -> list[str]:
    """Letter trigrams more frequent in the corpus's words than if all were equally frequent. Words are counted first, so a trigram is a row a word, not a row a place."""
    counted = docs.select(F.explode(F.regexp_extract_all(fold(F.col(text_col)), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substr(F.col("word"), i, F.lit(3)))
    counts = counted.select("n", F.explode(grams).alias("g")).groupBy("g").agg(F.sum("n").alias("n")).collect()  # at most 26**3 rows
    total = sum(r["n"] for r in counts)
    return sorted(r["g"] for r in counts if r["n"] * 26**3 >= total)


def with_features(found: DataFrame, trigrams: list[str]) -> DataFrame:
    """found (path, left, candidate, right, ...) and the columns FEATURES."""
    c, left = F.col("candidate"), F.coalesce(F.col("left"), F.lit(""))
    size = F.greatest(F.length(c), F.lit(1)).cast("double")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    chars = F.split(F.lower(c), "")
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.length(c) - 3, F.lit(0))), lambda i: F.concat_ws("", F.get("chars_", i), F.get("chars_", i + 1), F.get("chars_", i + 2)))
    common = F.filter(grams, lambda g: g.isin(trigrams)) if trigrams else F.array().cast("array<string>")
    around = F.concat_ws(" ", left, F.coalesce(F.col("right"), F.lit("")))
    said = lambda x: F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z]{2,}"), F.lit(0))
    return found.withColumn("chars_", chars).withColumns({
        "length": size,
        "transitions": F.regexp_count(c, F.lit(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])")) / size,
        "digits": F.regexp_count(c, F.lit("[0-9]")) / size,
        "capitals": F.regexp_count(c, F.lit("[A-Z]")) / size,
        "hex": F.regexp_count(c, F.lit("[0-9a-fA-F]")) / size,
        "distinct": F.size(F.array_distinct("chars_")) / size,
        "coverage": F.size(common) / F.greatest(size - 2, F.lit(1.0)),
        "announced": flag(left.rlike(ANNOUNCE)),
        "harmless": flag(left.rlike(HARMLESS)),
        "placeholder": flag(F.concat(around, c).rlike(PLACEHOLDER)),
        "assigned": flag(left.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(left.rlike(r"[\"']$")),
        "place": flag(F.col("path").rlike(PLACE)),
        "near_words": F.concat(F.slice(F.reverse(said(left)), 1, 4), F.slice(said(F.col("right")), 1, 2)),
    }).drop("chars_")


def hashed_words(found: DataFrame) -> DataFrame:
    return HashingTF(inputCol="near_words", outputCol="near_slots", numFeatures=NEAR_SLOTS, binary=True).transform(found)


def vectors(found: DataFrame, neighbours: LogisticRegressionModel) -> DataFrame:
    """found with its features and what its neighbouring words say as one vector."""
    told = neighbours.transform(hashed_words(found)).withColumn("neighbours", vector_to_array("near_said")[1]).drop("near_slots", "near_raw", "near_said", "near_label")
    return VectorAssembler(inputCols=[*FEATURES, "neighbours"], outputCol="features").transform(told)


def scan_secrets(docs: DataFrame, findings: DataFrame, *, max_rows: int = 20_000, trees: int = 24, depth: int = 7, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, nth, candidate, left, score, secret) of every candidate in docs. findings: path, left, candidate, right, label (0 or 1), the labelled findings."""
    trigrams = common_trigrams(docs, text_col)
    labelled = findings.select("path", "left", "candidate", "right", F.col("label").cast("double").alias("label")).filter("label in (0, 1) and candidate is not null")
    labelled = stored(hashed_sample(labelled, ["candidate", "left"], max_rows), "labelled-findings")
    kinds = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    rows = with_features(candidates(docs, id_col, text_col, path_col), trigrams)
    if len(kinds) < 2:
        score = F.lit(float(next(iter(kinds), 0.5)))
        return rows.select(F.col("id").alias(id_col), "nth", "candidate", "left", score.alias("score"), (score >= 0.5).alias("secret"))
    labelled = with_features(labelled, trigrams)
    neighbours = LogisticRegression(featuresCol="near_slots", regParam=0.01, standardization=False, rawPredictionCol="near_raw", probabilityCol="near_said", predictionCol="near_label").fit(hashed_words(labelled))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="0.6", maxBins=256).fit(vectors(labelled, neighbours))
    out = forest.transform(vectors(rows, neighbours)).withColumn("score", vector_to_array("probability")[1])
    return out.select(F.col("id").alias(id_col), "nth", "candidate", "left", "score", (F.col("score") >= 0.5).alias("secret"))


def label(found: DataFrame) -> DataFrame:
    """found (left, candidate, ...) and label: 1 for issuers' formats and announced values of any key alphabet, 0 for what is known to be none, null where neither can be told.

    A value of a key alphabet is hexadecimal, or has a digit and is not three quarters words. None are: words without a digit, plain numbers, and values named as digests or ids, unless announced.
    """
    c, left = F.col("candidate"), F.coalesce(F.col("left"), F.lit(""))
    wordy = F.length(F.regexp_replace(c, WORDS, "")) * 4 <= F.length(c)
    hexed, digit, announced = c.rlike("^[0-9a-fA-F]{16,}$"), c.rlike("[0-9]"), left.rlike(ANNOUNCED)
    secret = c.rlike(ISSUED) | left.rlike(WEB_TOKEN) | (announced & (hexed | (digit & ~wordy)) & ~c.rlike(PLACEHOLDER))
    none = ~announced & ((wordy & ~digit) | c.rlike("^[0-9]+$") | (left.rlike(HARMLESS) & ~left.rlike(ANNOUNCE)))
    return found.withColumn("label", F.when(secret, 1).when(none, 0))


def labelled_by_issuer(docs: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """The findings that label can tell, from the documents of at most max_rows ids (in hash order)."""
    ids = stored(hashed_sample(docs.select("doc_id"), ["doc_id"], max_rows), "sampled-ids")
    found = candidates(docs.select("doc_id", "text", "source").join(small(ids), "doc_id", "left_semi"))
    return stored(label(found).filter("label is not null"), "issuers-findings")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, labelled_by_issuer(docs))
    return found.select("doc_id", "nth", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("finding_sha256"), F.round("score", 6).alias("score"), "secret")
