"""Operator 5, toxicity: maximum-scoring segments over token log-odds, judged by extreme-value statistics.

Training, on a bounded sample of labelled rows (``max_rows``, a documented bound; rows in the order of a hash of their id):
* two thirds give token scores: log-odds of toxic against clean documents that hold the token, with a Dirichlet prior. The prior of a word is centred
  on what its prefix says, the prefix's on its shorter prefix, down to the base rate; so a word never seen is scored by its stem.
  ``drift`` is taken off, which makes ordinary text lose score token by token.
* one third calibrates: the best segment of clean texts follows an extreme-value law with scale 1 / lambda and location ln(K n) / lambda for n tokens;
  lambda and K are fitted by quantiles, and a logistic curve over the extreme-value statistics gives the probability.

A token counts in favour at most once in any AGAIN (16) tokens, in training, calibration and scoring alike: a word that a clean text repeats is no evidence each time,
but uses further ahead, however many, take nothing from a passage, and a passage that comes again counts again.

Scoring scans each whole text once: all maximal scoring segments in linear time (Ruzzo and Tompa's stack), each with its E-value K n exp(-lambda s); those of
at most ``e_value`` are the toxic passages. A document's score is the calibrated probability given the sum statistic of its best
segments and the number of its passages.

Scale: one map over the texts with a model bounded by the sample; no shuffle. Texts are worked on one after another, in batches of about a megabyte.

Cases: null and empty texts have no token and get the score of no evidence; very long texts are scanned whole, and longer ones need more to stand out (the E-value grows with n); equal scores of labelled rows are no ties to break, as nothing is ranked; without labels of both kinds among the rows that
give token scores nothing was learnt: every score is the smoothed share of label 1, but at most NO_EVIDENCE (0.49), so nothing is predicted toxic, and reject_toxic keeps all rows; repeated rows are scored each; labels of null toxic, or for ids not in the corpus, are ignored; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import by_bytes, hashed_sample, table, text_batches, words

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Lengths of the prefixes a word's prior backs off to, longest last.
STEMS = (3, 4, 5, 6, 7, 8)
#: Tokens from one place where a token counts in favour to the next: repeats in a phrase are no news, those in another passage are.
AGAIN = 16
#: Most tokens whose scores a worker remembers, and as many older ones.
REMEMBERED = 150_000
#: Token counts a worker gathers before it passes them on.
GATHERED = 200_000
#: The highest score where nothing was learnt.
NO_EVIDENCE = 0.49


def log_odds(counts: dict[int, dict[str, tuple[int, int]]], base: float, prior: float) -> dict[int, dict[str, float]]:
    """Of every token (level 0) and prefix (level: its length): log-odds against the base rate, each shrunk towards its next shorter prefix by prior."""
    shares: dict[int, dict[str, float]] = {}
    for level in (*STEMS, 0):
        shares[level] = {t: (y + prior * nearest(shares, t, level, base)) / (n + prior) for t, (y, n) in counts.get(level, {}).items()}
    at = math.log(base / (1 - base))
    return {level: {t: math.log(x / (1 - x)) - at for t, x in own.items()} for level, own in shares.items()}


def nearest(known: dict[int, dict[str, float]], token: str, below: int, otherwise: float) -> float:
    """What is known of the longest prefix of fewer characters than below (0: of any length)."""
    for level in reversed(STEMS):
        if (level < below or not below) and (found := known.get(level, {}).get(token[:level])) is not None:
            return found
    return otherwise


class TokenScores(dict):
    """Token to score: its log-odds, or those of its longest known prefix, less the drift. The most recent ones are remembered."""

    def __init__(self, odds: dict[int, dict[str, float]], drift: float) -> None:
        super().__init__()
        self.odds, self.drift, self.older = odds, drift, {}

    def __missing__(self, token: str) -> float:
        out = self.older.get(token)
        if out is None:
            out = self.odds.get(0, {}).get(token)
            out = (nearest(self.odds, token, 0, 0.0) if out is None else out) - self.drift
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[token] = out
        return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, behind the last, score) by Ruzzo and Tompa's rule, in linear time; runs of positive scores enter as one."""
    plus = np.zeros(len(scores) + 2, bool)
    plus[1:-1] = scores > 0
    edges = np.flatnonzero(plus[1:] != plus[:-1])
    if not len(edges):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[float, float, int, int, int]] = []  # total before, total behind, first, end, place of the next entry with less before
    for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        left, right = float(total[first]), float(total[end])
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, end, j))
                break
            left, first, back = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = back
    return [(a, b, r - l) for l, r, a, b, _ in stack]


@dataclass
class Model:
    odds: dict[int, dict[str, float]]  # by level, as log_odds gives them
    base: float
    drift: float
    e_value: float
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None  # the smoothed share of label 1, if there is nothing to learn

    def scores(self) -> TokenScores:
        return TokenScores(self.odds, self.drift)

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float, list[tuple[int, int, float, float]]]:
        """(evidence of all segments together, ln(1 + passages), passages with E-values).

        The evidence is the largest -ln P over the r best segments, P by the sum statistic of Karlin and Altschul (1993).
        """
        room = self.log_k + math.log(max(n, 1))
        most, total = 0.0, 0.0
        for r, s in enumerate(sorted((x[2] for x in found), reverse=True), 1):
            if self.rate * s <= room:
                break
            total += self.rate * s - room
            most = max(most, total - (r - 1) * math.log(max(total, 1e-9)) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
        passages = [(a, b, s, math.exp(min(room - self.rate * s, 50.0))) for a, b, s in found]
        passages = [x for x in passages if x[3] <= self.e_value]
        return min(most, 200.0), math.log1p(len(passages)), passages

    def probability(self, best: float, count: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, a + b * best + c * count))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps, slopes kept non-negative."""
    x1 = np.column_stack([np.ones(len(x)), x])
    w, pen = np.zeros(x1.shape[1]), np.array([1e-6, *[ridge] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -35, 35)))
        grad = x1.T @ (y - p) - pen * w
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(pen)
        step = np.linalg.solve(hess, grad)
        w = w + step
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 15_000, prior: float = 60.0, drift: float = 0.5, min_docs: int = 3, e_value: float = 0.05) -> Model:
    """Learns from at most max_rows labelled rows."""
    text_batches(docs.sparkSession)
    sample = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and id is not null")
    sample = hashed_sample(sample, ["id"], max_rows).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    counted = rows.groupBy("part").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
    ones, every = sum(r["y"] for r in counted), sum(r["n"] for r in counted)
    fit = [(r["y"], r["n"]) for r in counted if r["part"] > 0]
    fit_ones, fit_every = sum(f[0] for f in fit), sum(f[1] for f in fit)
    model = Model({}, (fit_ones + 0.5) / (fit_every + 1), drift, e_value)
    if not 0 < fit_ones < fit_every:
        model.constant = (ones + 1) / (every + 2)
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares: dict[int, dict[str, int]] = {level: {} for level in (0, *STEMS)}  # documents with the token times 2**32, plus toxic ones

        def told() -> Iterator[pa.RecordBatch]:
            for level, own in shares.items():
                both = np.fromiter(own.values(), np.int64, len(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), level, np.int32)), pa.array(list(own), pa.string()), pa.array(both & 0xFFFFFFFF), pa.array(both >> 32)], ["level", "token", "y", "n"])
                own.clear()

        for batch in by_bytes(batches, "text"):
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                tokens = set(TOKEN.findall(text.lower()))
                for level, own in shares.items():
                    for token in {t[:level] for t in tokens} if level else tokens:
                        own[token] = own.get(token, 0) + (1 << 32) + y
            if sum(map(len, shares.values())) > GATHERED:
                yield from told()
        yield from told()

    counts = rows.filter("part > 0").select("y", "text").mapInArrow(count, "level int, token string, y long, n long").groupBy("level", "token").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    counts = counts.filter((F.col("n") >= min_docs) & ((F.col("y") > 0) | (F.col("n") * 8 >= prior)))  # rarer ones without a toxic document hardly move the prior
    seen: dict[int, dict[str, tuple[int, int]]] = {}
    for batch in counts.toArrow().to_batches():  # bounded by the sample's tokens
        for level, token, y, n in zip(*(batch.column(c).to_pylist() for c in ("level", "token", "y", "n"))):
            seen.setdefault(level, {})[token] = (y, n)
    model.odds = log_odds(seen, model.base, prior)
    del seen
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Model(**sent.value).scores()
        for batch in by_bytes(batches, "text"):
            found = [scan(scores, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([f[0] for f in found], pa.int32()), pa.array([[s for _, _, s in f[1]] for f in found], pa.list_(pa.float64()))], ["y", "n", "all"])

    held = rows.filter("part = 0").select("y", "text").mapInArrow(measure, "y int, n int, all array<double>").toPandas()
    best = np.array([max(a, default=0.0) if a is not None else 0.0 for a in held["all"]])
    clean = (held.y == 0).to_numpy() & (held.n > 0).to_numpy()
    if clean.sum() >= 10 and best[clean].std() > 1e-6:
        low, high = np.quantile(best[clean], (0.5, 0.9))
        model.rate = 1.8839 / max(high - low, 1e-3)  # between these quantiles of a Gumbel law lie 1.8839 scales
        model.log_k = float(np.median(model.rate * best[clean] - np.log(held.n.to_numpy()[clean]))) - 0.3665
    x = np.array([model.evidence(n, [(0, 0, s) for s in (a if a is not None else ())])[:2] for n, a in zip(held.n, held["all"])]).reshape(-1, 2)
    y = held.y.to_numpy(float)
    if 0 < y.sum() < len(y):
        model.curve = tuple(logistic(x, y))
    else:
        model.curve = (math.log(model.base / (1 - model.base)) - 1, 0.5, 0.5)
    sent.unpersist()
    return model


def scan(scores: TokenScores, text: str) -> tuple[int, list[tuple[int, int, float]]]:
    """Tokens and segments of a text. A token counts in favour once in AGAIN tokens; a nearer repeat only costs the drift."""
    tokens = TOKEN.findall(text.lower())
    found = np.fromiter(map(scores.__getitem__, tokens), float, len(tokens))
    counted: dict[str, int] = {}  # where each token counted last
    for i in np.flatnonzero(found > 0).tolist():
        if i - counted.get(tokens[i], -AGAIN) < AGAIN:
            found[i] = -scores.drift
        else:
            counted[tokens[i]] = i
    return len(tokens), segments(found)


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, score, n_tokens, passages array<struct<first_token, end_token, start, end, log_odds, e_value>>) for every row; start and end are character offsets.

    If the model learnt nothing, every score is its constant, but at most NO_EVIDENCE.
    """
    if model.constant is not None:
        none = F.array().cast("array<struct<first_token:int,end_token:int,start:int,end:int,log_odds:double,e_value:double>>")
        return docs.select(id_col, *keep, F.lit(min(model.constant, NO_EVIDENCE)).alias("score"), F.size(words(F.col(text_col))).alias("n_tokens"), none.alias("passages"))
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(**sent.value)
        scores = model.scores()
        for pdf in frames:
            out, counts, told = [], [], []
            for text in pdf["text_"]:
                text = text or ""
                n, found = scan(scores, text)
                best, count, passages = model.evidence(n, found)
                out.append(model.probability(best, count))
                counts.append(n)
                spans = [m.span() for m in TOKEN.finditer(text)] if passages else []
                told.append([{"first_token": a, "end_token": b, "start": spans[min(a, len(spans) - 1)][0], "end": spans[min(b, len(spans)) - 1][1], "log_odds": s, "e_value": e} for a, b, s, e in passages])
            yield pdf.drop(columns="text_").assign(score=out, n_tokens=counts, passages=told)

    rows = docs.select(id_col, *keep, F.col(text_col).alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInPandas(judge, f"{schema}, score double, n_tokens int, passages array<struct<first_token:int,end_token:int,start:int,end:int,log_odds:double,e_value:double>>")


def reject_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score below threshold, all columns as they are; all rows if the model learnt nothing."""
    if model.constant is not None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    at = docs.columns.index(text_col)
    text_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**sent.value)
        scores = model.scores()
        for batch in by_bytes(batches, text_col):
            mask = [model.probability(*model.evidence(*scan(scores, text or ""))[:2]) < threshold for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def trained(spark: SparkSession, sf_dir: str) -> Model:
    """From the labelled rows of documents outside fold 0."""
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(fold(F.col("doc_id")) != 0))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
