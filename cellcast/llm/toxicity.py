"""Toxicity by maximum-scoring segments.

Every token scores its log-odds of toxic against clean documents under an informative Dirichlet
prior, drawn towards zero by its standard error, less a small ``STEP``: evidence for either side
counts, and a token that tells nothing costs ``STEP``.  A linear-time scan over the scores finds
all maximal scoring segments of a text, so every toxic passage is found and none twice.  Segment
scores follow an extreme-value law in clean text: ``lambda`` solves E[exp(lambda * s)] = 1 over
clean tokens and ``K`` is fitted to the best segments of clean documents, which gives each passage
an expected count E = K * n * exp(-lambda * S).  A logistic calibration of the extreme-value
scores, fitted out of fold, turns them into a probability.

Training reads labelled rows only where crc32(doc_id as text) mod 5 is not 0, and of these a
bounded sample (``MAX_TOXIC`` and ``MAX_CLEAN`` rows, by the smallest hash of doc_id).  Neither
labels, lang, source nor doc_id enter a score.  The lexicon has every token of the sample whose
log-odds are not drawn to zero, however many there are; the sample bounds it.

Defined results: a null or empty text has no tokens and gets the calibrated score of an empty
text; repeated rows get equal scores; a null ``doc_id`` is never trained on nor held out; labels
of one document that differ count as toxic; without labels of both classes every score is
``PRIOR``; an empty table gives an empty table.  A text of any length is scanned whole.  Scores
have columns of their own; the stage that drops rows carries all columns of its input through,
whatever they are called.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.llm.common import SharedTables, sliced, tune

MAX_TOXIC, MAX_CLEAN = 4_000, 12_000
FOLDS = 5  # fold 0 is held out; folds 1 to 4 train
PRIOR_DOCS = 500.0  # strength of the Dirichlet prior, in documents
CAUTION = 1.64  # standard errors taken off a token's log-odds
STEP = 0.05  # taken off every token's log-odds
PRIOR = 0.1
SIGNIFICANT = 1.0

_TOKEN = re.compile(r"\w+")

PASSAGES = "array<struct<start: long, end: long, score: double, expected: double>>"
SCHEMA = f"doc_id long, held_out boolean, score double, predicted int, passages {PASSAGES}"


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def segments(hits: list[tuple[int, float]], step: float = STEP) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first token, last token, score).

    ``hits`` are the positions with log-odds, in order; every position costs ``step`` besides.
    Each candidate keeps the running total before and after it, and which earlier candidate is the
    nearest that started lower; a new hit follows these links, so each is passed over once.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, link
    total, at = 0.0, 0
    for i, w in hits:
        before = total - step * (i - at)
        total, at = before + w - step, i + 1
        if total <= before:
            continue
        first = i
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, i, before, total, j))
                break
            first, _, before, _, link = found[j]  # joins all from that candidate on
            del found[j:]
            j = link
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


def features(n: int, parts: list[tuple[int, int, float]], decay: float, k: float) -> tuple[float, float, float]:
    """Best extreme-value score, length, and the evidence of all significant passages."""
    best = max((decay * s for *_, s in parts), default=0.0)
    room = math.log(max(k * n, 1e-9))
    return best, math.log1p(n), math.log1p(sum(decay * s for *_, s in parts if room - decay * s < math.log(SIGNIFICANT)))


def log_odds(toxic, clean, n_toxic: float, n_clean: float, strength: float):
    """Log-odds of a token (numbers of documents that hold it, as columns), drawn towards zero.

    ``n_toxic`` and ``n_clean`` are the sums of these numbers over all tokens, so that one class
    having longer documents does not speak for it; ``strength`` is the prior's part of them.  What
    is left is 0 where the odds are within ``CAUTION`` standard errors of even.
    """
    share = F.greatest(toxic + clean, F.lit(0.5)) / F.lit(max(n_toxic + n_clean, 1.0))
    prior = F.lit(strength) * share

    def odds(count, n: float):
        return F.ln((count + prior) / F.greatest(F.lit(n + strength) - count - prior, F.lit(1e-3)))

    apart = odds(toxic, n_toxic) - odds(clean, n_clean)
    error = F.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return F.signum(apart) * F.greatest(F.abs(apart) - CAUTION * error, F.lit(0.0))


def decay_rate(weights: np.ndarray, rates: np.ndarray, step: float = STEP) -> float:
    """The positive root of E[exp(x * s)] = 1 over clean tokens, by bisection.

    ``rates`` are the shares of clean tokens that have the log-odds ``weights``; the rest has none.
    Without a root it is 1, that of log-odds which are exact.
    """
    rest = max(0.0, 1 - rates.sum())
    scores = weights - step
    if not (scores > 0).any() or float(rates @ scores) - rest * step >= 0:
        return 1.0
    low, high = 1e-4, 1e-4
    value = lambda x: float(rates @ np.exp(np.minimum(x * scores, 600))) + rest * math.exp(-x * step) - 1
    while value(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Newton's method with step halving; the last coefficient is the intercept.

    The loss is convex and a step is only taken if it lowers it, so the result does not hang on
    rounding: full steps alone swing between signs where a feature is wide and classes part well.
    """
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(weight @ (np.logaddexp(0, z) - y * z) + penalty @ (v * v) / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, slope)
        least, size = float(slope @ step), 1.0
        while (then := loss(w - size * step)) > now - 1e-4 * size * least and size > 1e-10:
            size /= 2
        if then >= now:
            break
        w, now = w - size * step, then
        if least < 1e-10 * (1 + abs(now)):
            break
    return w


def fold_of(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, target: str) -> tuple[DataFrame, list[int]]:
    """Bounded training rows (doc_id, fold, label, text), and the labelled rows of each class."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where(f"doc_id is not null and label in (0, 1) and crc32(cast(doc_id as string)) % {FOLDS} != 0")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label, limit in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = docs.join(F.broadcast(chosen), "doc_id").withColumn("fold", fold_of().cast("int"))
    return picked.select("doc_id", "fold", "label", "text"), [sizes.get(1, 0), sizes.get(0, 0)]


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each slice that hold a token, by fold and label, and how often they do.

    The empty token stands for all: the documents, and the sum of their distinct tokens.
    """
    for batch in sliced(batches, "text", 1 << 20):
        held: dict[tuple[str, int], list[int]] = {}
        for fold, label, text in zip(*(batch.column(c).to_pylist() for c in ("fold", "label", "text"))):
            words = tokens(text)
            every = held.setdefault(("", fold * 2 + label), [0, 0])
            every[0] += 1
            every[1] += len(set(words))
            for word in words:
                held.setdefault((word, fold * 2 + label), [0, 0])[1] += 1
            for word in set(words):
                held[word, fold * 2 + label][0] += 1
        rows = [(w, c, d, n) for (w, c), (d, n) in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["token", "cell", "docs", "times"])


class Model:
    """Lexicons (one for each training fold left out, and the whole), and the calibration."""

    def __init__(self, lexicons: list[dict[str, float]], laws: list[tuple[float, float]], weights):
        self.lexicons, self.laws, self.weights = lexicons, laws, weights

    def scan(self, text: str | None, fold: int = 0):
        words = tokens(text)
        lexicon = self.lexicons[fold]
        return words, segments([(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon])

    def for_scoring(self) -> Model:
        """Without the lexicons that only the calibration needed."""
        return Model(self.lexicons[:1], self.laws[:1], self.weights)

    def score(self, n: int, parts) -> float:
        if self.weights is None:
            return PRIOR
        z = float(np.dot(features(n, parts, *self.laws[0]), self.weights[:-1]) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> Model:
    spark = docs.sparkSession
    shared = SharedTables(spark, "toxicity")
    rows, sizes = sample(docs, labels, target)
    if not all(sizes):
        return Model([{}] * FOLDS, [(1.0, 1.0)] * FOLDS, None)
    rows = shared.write(rows, "sample")
    counted = rows.mapInArrow(count_tokens, "token string, cell long, docs long, times long").groupBy("token")
    cells = [F.sum(F.when(F.col("cell") == c, F.col(v)).otherwise(0)).alias(f"{v}{c}") for v in ("docs", "times") for c in range(2 * FOLDS)]
    table = counted.agg(*cells)
    table = shared.write(table, "tokens")
    totals = table.where("token = ''").first()
    if not totals:
        return Model([{}] * FOLDS, [(1.0, 1.0)] * FOLDS, None)
    others = [[f for f in range(1, FOLDS) if f != left] for left in range(FOLDS)]  # folds that train when one is left out
    gathered = lambda what, c, folds: sum((F.col(f"{what}{2 * f + c}") for f in folds), F.lit(0))
    size = lambda what, folds, classes=(0, 1): float(sum(totals[f"{what}{2 * f + c}"] for f in folds for c in classes))
    strength = lambda o: PRIOR_DOCS * size("times", o) / max(size("docs", o), 1.0)
    weights = F.array(*[log_odds(gathered("docs", 1, o), gathered("docs", 0, o), size("times", o, (1,)), size("times", o, (0,)), strength(o)) for o in others])
    times = F.array(*[gathered("times", 0, o).cast("double") for o in others])
    words = table.where("token != ''").select("token", weights.alias("weights"), times.alias("times"))
    clean_times = words.select(F.transform(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda i: F.get("times", i)).alias("t")).agg(*[F.sum(F.get("t", F.lit(i))).alias(str(i)) for i in range(FOLDS)]).first()
    kept = words.where(F.exists("weights", lambda w: w != 0)).orderBy("token").toPandas()
    shared.drop("tokens")
    lexicons, laws = [], []
    matrix = np.array(kept["weights"].to_list(), float).reshape(-1, FOLDS)
    counts = np.array(kept["times"].to_list(), float).reshape(-1, FOLDS)
    for left in range(FOLDS):
        some = np.flatnonzero(matrix[:, left])
        weight = matrix[some, left]
        rates = (counts[some, left] + 0.5) / max(1.0, clean_times[str(left)] or 0.0)
        lexicons.append(dict(zip(kept["token"].to_numpy()[some].tolist(), weight.tolist())))
        laws.append((decay_rate(weight, rates), 1.0))
    model = Model(lexicons, laws, None)
    best = rows.mapInArrow(_out_of_fold(model), "fold int, label int, n long, scores array<double>").toPandas()
    for left in range(FOLDS):  # location of the extreme-value law over clean documents
        own = best[(best["label"] == 0) & (best["n"] > 0) & ((best["fold"] == left) | (left == 0))]
        excess = [laws[left][0] * max(s, default=0.0) - math.log(n) for s, n in zip(own["scores"], own["n"])]
        laws[left] = (laws[left][0], math.exp(min(0.0, (float(np.mean(excess)) if excess else 0.0) - 0.5772)))
    x = np.array([features(n, [(0, 0, s) for s in scores], *laws[fold]) for fold, n, scores in zip(best["fold"], best["n"], best["scores"])])
    y = best["label"].to_numpy(float)
    taken = np.array([(y == 1).sum(), (y == 0).sum()])
    if not taken.all():
        return model
    model.weights = logistic(x, y, np.where(y == 1, sizes[0] / taken[0], sizes[1] / taken[1]))
    shared.drop("sample")
    return model


def _out_of_fold(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            rows = []
            for fold, label, text in zip(*(batch.column(c).to_pylist() for c in ("fold", "label", "text"))):
                words, parts = model.scan(text, fold)
                rows.append((fold, label, len(words), [s for *_, s in parts]))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["fold", "label", "n", "scores"])

    return run


def scorer(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        decay, k = model.laws[0]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in sliced(batches, "text", 1 << 20):
            scores, passages = [], []
            for text in batch.column("text").to_pylist():
                words, parts = model.scan(text)
                scores.append(model.score(len(words), parts))
                expected = [k * len(words) * math.exp(-min(decay * s, 600.0)) for *_, s in parts]
                passages.append([{"start": a, "end": b + 1, "score": s, "expected": e} for (a, b, s), e in zip(parts, expected) if e <= SIGNIFICANT])
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "passages"])

    return run


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def score_toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> DataFrame:
    """Score, verdict and significant passages (token ranges) of every row of ``docs``.

    Training scans the table once for its bounded sample; scoring is a narrow map.  The lexicons
    that are broadcast have only tokens of that sample.
    """
    spark: SparkSession = tune(docs.sparkSession)
    texts = texts_of(docs)
    model = spark.sparkContext.broadcast(train(texts, labels, target).for_scoring())
    held = texts.withColumn("held_out", F.coalesce(fold_of() == 0, F.lit(False)))
    return held.mapInArrow(scorer(model), SCHEMA)


def clean_rows(docs: DataFrame, model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not reject."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.value
        for batch in sliced(batches, "text", 1 << 20):
            keep = []
            for text in batch.column("text").to_pylist():
                words, parts = judge.scan(text)
                keep.append(judge.score(len(words), parts) < 0.5)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
