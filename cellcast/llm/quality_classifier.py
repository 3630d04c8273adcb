"""Quality by co-training two views of a document.

The text view sees what the text says, as log-odds of its words (hashed to ``WORD_SLOTS`` slots and
counted in the labelled rows, without the row's own fold), and what it is like (word lengths,
symbols, repetition, variety); the metadata view sees what is known about it without reading it
(language, source, stated length).
Both start from the labelled rows; in each round either view labels the unlabelled documents it is
most sure of, and these join the other view's training rows.  The views are then calibrated, and
combined by a logistic model, on a training fold that neither has seen, and score all documents.

Training reads rows only where crc32(doc_id as text) mod 5 is not 0: of the labelled ones at most
``MAX_LABELLED`` of each class, by smallest hash, and all unlabelled ones.  The executors score
these in every round and move the surest ``SHARE`` of them; what comes back is sums.

Defined results: null and empty texts have all-zero text features; null metadata is a value of its
own; a null ``doc_id`` is never trained on nor held out; repeated rows get equal scores; labels of
one document that differ count as good; without labels of both classes every score is ``PRIOR``;
an empty table gives an empty table.  Texts of any length are read whole.  Of the table only
``doc_id``, ``text``, ``lang``, ``source`` and ``n_chars`` are read, so others may have any name.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.llm.common import SharedTables, Words, sliced, tune
from cellcast.llm.quality_rules import duplicate_lines, repeated_words
from cellcast.llm.toxicity import FOLDS, fold_of, logistic

MAX_LABELLED = 4_000
ROUNDS = 5
EACH_ROUND = 400  # least number of rows that a view labels in a round, half of each class
SHARE = 1 / 80  # of all unlabelled rows, by class, view and round
RIDGE = 3.0
NEWTON = 30  # passes of a fit at most
WORD_SLOTS = 1 << 13
WORD_PRIOR = 4.0  # documents of either class that a word is taken to be in beforehand
BINS = 250  # of a unit of logits
SURE = 0.9
CALIBRATION_FOLD = 4
PRIOR = 0.5
LANG_SLOTS, SOURCE_SLOTS = 8, 32

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, kept boolean, text_score double, metadata_score double"

_CLASSES = np.zeros((256, 5))
for _column, _bytes in enumerate((b"#*$%&|<>", b"!?", b"0123456789", b".,;:", bytes(range(ord("A"), ord("Z") + 1)))):
    _CLASSES[list(_bytes), _column] = 1


def word_slots(words: Words) -> np.ndarray:
    return (words.hash & np.uint64(WORD_SLOTS - 1)).astype(np.int64)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by fold and label (``cell``), and those of them that hold a slot's words; slot -1 has all."""
    for batch in sliced(batches, "text", 1 << 20):
        words = Words(batch.column("text"))
        text = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
        cell = batch.column("fold").to_numpy() * 2 + batch.column("label").to_numpy()
        held = np.unique(text * WORD_SLOTS + word_slots(words))
        keys, times = np.unique(cell[held // WORD_SLOTS] * WORD_SLOTS + held % WORD_SLOTS, return_counts=True)
        every = np.bincount(cell, minlength=2 * FOLDS)
        cells = np.concatenate((keys // WORD_SLOTS, np.arange(2 * FOLDS)))
        slots = np.concatenate((keys % WORD_SLOTS, np.full(2 * FOLDS, -1)))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (cells, slots, np.concatenate((times, every)))], names=["cell", "slot", "docs"])


def word_weights(counted) -> np.ndarray:
    """Log-odds of good against bad for every slot, with each fold left out (fold 0 has all)."""
    held, size = np.zeros((2 * FOLDS, WORD_SLOTS)), np.zeros(2 * FOLDS)
    for cell, slot, docs in zip(counted["cell"], counted["slot"], counted["docs"]):
        if slot < 0:
            size[cell] = docs
        else:
            held[cell, slot] = docs
    out = np.zeros((FOLDS, WORD_SLOTS))
    for left in range(FOLDS):
        folds = [f for f in range(1, FOLDS) if f != left]
        bad, good = (held[[2 * f + c for f in folds]].sum(axis=0) for c in (0, 1))
        n_bad, n_good = (size[[2 * f + c for f in folds]].sum() for c in (0, 1))
        prior = WORD_PRIOR * (bad + good + 0.5) / (n_bad + n_good + 1)
        out[left] = np.log((good + prior) / (n_good + WORD_PRIOR)) - np.log((bad + prior) / (n_bad + WORD_PRIOR))
    return out


def word_features(words: Words, weights: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Mean log-odds of a text's words, and the means of what speaks for either side."""
    counts = np.diff(words.first)
    own = weights[np.repeat(fold, counts), word_slots(words)]
    per = lambda v: np.diff(np.concatenate(([0.0], np.cumsum(v)))[words.first]) / np.maximum(counts, 1)
    return np.column_stack([per(own), per(np.maximum(own, 0)), per(np.minimum(own, 0))])


def text_features(words: Words) -> np.ndarray:
    """Twelve measures of each text."""
    counts = np.diff(words.first)
    least = np.maximum(counts, 1)
    per = lambda v: np.diff(np.concatenate(([0.0], np.cumsum(v)))[words.first])
    length = (words.end - words.start).astype(float)
    out = [np.log1p(counts), per(length) / least, np.sqrt(np.maximum(per(length**2) / least - (per(length) / least) ** 2, 0))]
    for column in range(_CLASSES.shape[1]):
        total = np.concatenate(([0.0], np.cumsum(_CLASSES[words.data, column])))
        out.append(np.diff(total[words.offsets]) / least)
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((words.hash, text))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (text[order][1:] != text[order][:-1])
    out.append(np.bincount(text[order][fresh], minlength=len(counts)) / least)
    again = np.zeros(len(words), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    out += [per(again) / least, per(repeated_words(words, 4)) / least]
    lines = [duplicate_lines(words.data[a:b].tobytes())[1] for a, b in zip(words.offsets[:-1], words.offsets[1:])]
    out.append(np.array(lines, float) / np.maximum(per(length), 1))
    return np.column_stack(out) if len(counts) else np.zeros((0, 12))


def metadata_features(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros((batch.num_rows, 2 + LANG_SLOTS + SOURCE_SLOTS))
    for row, (lang, source, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))):
        out[row, 0] = np.log1p(max(size or 0, 0))
        out[row, 1] = size is None
        out[row, 2 + zlib.crc32(repr(lang).encode()) % LANG_SLOTS] = 1
        out[row, 2 + LANG_SLOTS + zlib.crc32(repr(source).encode()) % SOURCE_SLOTS] = 1
    return out


class View:
    """Standardised features (and their squares) with a logistic model."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        self.mean, self.std = mean, std + 1e-6
        self.w = np.zeros(len(mean) + 1)

    @staticmethod
    def wide(x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.log1p(np.abs(x)), x > 0.25))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((self.wide(x) - self.mean) / self.std, -8, 8)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.w = logistic(self.scaled(x), y, weight, ridge=RIDGE)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scaled(x) @ self.w[:-1] + self.w[-1], -20, 20)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def gather(weights):
    """Both views of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        kind = pa.list_(pa.float64())
        for batch in sliced(batches, "text", 1 << 20):
            words = Words(batch.column("text"))
            fold = np.nan_to_num(batch.column("fold").to_numpy(zero_copy_only=False)).astype(np.int64)
            views = np.column_stack((text_features(words), word_features(words, table, fold))), metadata_features(batch)
            own = [batch.column(c) for c in ("doc_id", "held_out", "fold")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(list(v), kind) for v in views)], names=["doc_id", "held_out", "fold", "text", "metadata"])

    return run


def views_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("text", "metadata")]


def summed(rows: DataFrame, measure) -> np.ndarray:
    """The sum over all rows of what ``measure`` makes of a batch: one array for each task comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = measure(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = [np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, "sums binary").collect()]
    return np.sum(parts, axis=0)


def moments(views: list[np.ndarray]) -> np.ndarray:
    wide = [View.wide(x) for x in views]
    return np.concatenate([[len(views[0])], *(f(x).sum(axis=0) for x in wide for f in (np.asarray, np.square))])


def guesses(history: list, views: list[np.ndarray]) -> list[np.ndarray]:
    """What the other view has told each view in the rounds so far: 1, 0, or -1 for nothing."""
    told = [np.full(len(views[0]), -1) for _ in views]
    for models, cuts in history:
        for own, (model, x, (good, bad)) in enumerate(zip(models, views, cuts)):
            z, other = model.logit(x), told[1 - own]
            fresh = other < 0
            other[fresh & (z >= good)] = 1
            other[fresh & (z <= bad)] = 0
    return told


def sureness(history: list, models: list[View]):
    """Counts of the logits of rows that the other view knows nothing of, by view."""

    def measure(batch: pa.RecordBatch) -> np.ndarray:
        views = views_of(batch)
        told = guesses(history, views)
        place = [np.rint(m.logit(x)[told[1 - own] < 0] * BINS).astype(int) + 20 * BINS for own, (m, x) in enumerate(zip(models, views))]
        return np.concatenate([np.bincount(p, minlength=40 * BINS + 1) for p in place]).astype(float)

    return measure


def cuts_of(counts: np.ndarray, share: float) -> tuple[float, float]:
    """Logits from which on (and down to which) a row is among the surest ``share`` rows of a class."""
    least = np.log(SURE / (1 - SURE))
    out = []
    for each in (counts[::-1], counts):
        at = int(np.searchsorted(np.cumsum(each), share))
        out.append(max(20 - (at + 0.5) / BINS, least))
    return out[0], -out[1]


def told_rows(history: list):
    """The rows that a view has been told about, with what."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                told = guesses(history, views_of(batch))
                some = np.flatnonzero((told[0] >= 0) | (told[1] >= 0))
                own = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(t[some].astype(np.int32)) for t in told)], names=["text", "metadata", "told0", "told1"])

    return run


def curvature(model: View, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Hessian, gradient and value of the log-loss at the model's weights."""
    x = np.column_stack((model.scaled(x), np.ones(len(x))))
    z = x @ model.w
    p = sigmoid(np.clip(z, -500, 500))
    loss = weight @ (np.logaddexp(0, z) - y * z)
    return np.concatenate((((x * (weight * p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (weight * (p - y)), [loss]))


def told_curvature(models: list[View]):
    def measure(batch: pa.RecordBatch) -> np.ndarray:
        out = []
        for own, (model, x) in enumerate(zip(models, views_of(batch))):
            told = batch.column(f"told{own}").to_numpy()
            use = told >= 0
            out.append(curvature(model, x[use], told[use].astype(float), np.full(use.sum(), 0.5)))
        return np.concatenate(out)

    return measure


def refit(models: list[View], views: list[np.ndarray], y: np.ndarray, weight: np.ndarray, told: DataFrame) -> None:
    """Newton's method on the labelled rows (here) and the told rows (in the executors).

    A pass measures both views at the weights on trial.  Where the loss has not fallen, half the
    step is tried next, so neither view swings.
    """
    n = len(models)
    kept, loss, step, size = [m.w for m in models], [np.inf] * n, [None] * n, [1.0] * n
    for _ in range(NEWTON):
        far, at, moved = summed(told, told_curvature(models)), 0, 0.0
        for i, (model, x) in enumerate(zip(models, views)):
            d = len(model.w)
            both = curvature(model, x, y, weight)
            if np.ndim(far):
                both, at = both + far[at : at + len(both)], at + len(both)
            penalty = np.append(np.full(d - 1, RIDGE), 1e-6)
            value = both[-1] + penalty @ model.w**2 / 2
            if value <= loss[i]:
                kept[i], loss[i], size[i] = model.w, value, 1.0
                step[i] = np.linalg.solve(both[: d * d].reshape(d, d) + np.diag(penalty), both[d * d : -1] + penalty * model.w)
            else:
                size[i] /= 2
            model.w = kept[i] - size[i] * step[i]
            moved = max(moved, float(np.abs(size[i] * step[i]).max()))
        if moved < 1e-4:
            break
    for model, w in zip(models, kept):
        model.w = w


def co_train(views: list[np.ndarray], fold: np.ndarray, label: np.ndarray, sizes: dict[int, int], pool: DataFrame, shared: SharedTables):
    """The two views after their rounds, and the weights that combine their logits.

    The labelled rows are here; ``pool`` has the views of all unlabelled rows, which the executors
    score in every round.
    """
    labelled = fold != CALIBRATION_FOLD
    real = np.where(label == 1, sizes[1] / max((label == 1).sum(), 1), sizes[0] / max((label == 0).sum(), 1))
    real = real / real.mean()
    far = summed(pool, lambda batch: moments(views_of(batch)))
    total, n = moments(views) + far, int(far[0]) if np.ndim(far) else 0
    models, at = [], 1
    for x in views:
        d = View.wide(x[:1]).shape[1]
        mean, square = total[at : at + d] / total[0], total[at + d : at + 2 * d] / total[0]
        models.append(View(mean, np.sqrt(np.maximum(square - mean**2, 0))))
        models[-1].fit(x[labelled], label[labelled].astype(float), real[labelled])
        at += 2 * d
    share = max(EACH_ROUND // 2, n * SHARE)
    history: list = []
    for turn in range(ROUNDS if n else 0):
        counts = summed(pool, sureness(history, models)).reshape(2, -1)
        history.append((copy.deepcopy(models), [cuts_of(c, share) for c in counts]))
        told = shared.write(pool.mapInArrow(told_rows(history), "text array<double>, metadata array<double>, told0 int, told1 int"), f"told-{turn}")
        refit(models, [x[labelled] for x in views], label[labelled].astype(float), real[labelled], told)
        shared.drop(f"told-{turn}")
    held = np.flatnonzero(~labelled)
    z = np.column_stack([m.logit(x[held]) for m, x in zip(models, views)])
    y = label[held].astype(float)
    if len(set(y)) < 2:
        return models, np.array([[1, 0], [1, 0]], float), np.array([0.5, 0.5, 0.0])
    platt = [logistic(z[:, [v]], y, real[held], ridge=0.1) for v in (0, 1)]
    calibrated = np.column_stack([z[:, v] * platt[v][0] + platt[v][1] for v in (0, 1)])
    return models, np.array(platt), logistic(calibrated, y, real[held], ridge=1.0)


def labelled_sample(labels: DataFrame, target: str) -> tuple[DataFrame, DataFrame | None, dict[int, int]]:
    """All labelled documents, the bounded sample of those that train, and how many there are of each class."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    usable = known.where(fold_of() != 0)
    sizes = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    some = [usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED) for label in (0, 1)]
    return known, some[0].unionByName(some[1]) if len(sizes) == 2 else None, sizes


def train(rows: DataFrame, known: DataFrame, chosen: DataFrame, sizes: dict[int, int], shared: SharedTables):
    """Co-training over ``rows``, the views of all documents."""
    got = rows.join(F.broadcast(chosen), "doc_id").select("fold", "label", "text", "metadata").toPandas()
    if not {0, 1} <= set(got["label"]):
        return None
    pool = rows.where("doc_id is not null and fold <> 0").join(known, "doc_id", "left_anti").select("text", "metadata")
    pool = shared.write(pool, "pool")
    views = [np.stack(got[c].to_list()) for c in ("text", "metadata")]
    model = co_train(views, got["fold"].to_numpy(), got["label"].to_numpy(), sizes, pool, shared)
    shared.drop("pool")
    return model


def scorer(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if model is None:
                each, score = [np.full(n, PRIOR)] * 2, np.full(n, PRIOR)
            else:
                views, platt, mixed = model
                x = views_of(batch)
                z = [v.logit(f) * a + b for v, f, (a, b) in zip(views, x, platt)]
                each, score = [sigmoid(v) for v in z], sigmoid(z[0] * mixed[0] + z[1] * mixed[1] + mixed[2])
            good = score >= 0.5
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array(good.astype(np.int32)), pa.array(good), *(pa.array(e) for e in each)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """Score (probability of good quality) and verdict of every row of ``docs``."""
    spark = tune(docs.sparkSession)
    cast = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    rows = docs.select(*[F.col(c).cast(t).alias(c) for c, t in cast.items()])
    rows = rows.withColumns({"held_out": F.coalesce(fold_of() == 0, F.lit(False)), "fold": fold_of().cast("int")})
    shared = SharedTables(spark, "quality")
    known, chosen, sizes = labelled_sample(labels, target)
    weights = np.zeros((FOLDS, WORD_SLOTS))
    if chosen is not None:  # at most WORD_SLOTS rows for each fold and class come back
        chosen = shared.write(chosen, "chosen")
        counted = rows.join(F.broadcast(chosen), "doc_id").select("fold", "label", "text").mapInArrow(count_words, "cell long, slot long, docs long")
        weights = word_weights(counted.groupBy("cell", "slot").agg(F.sum("docs").alias("docs")).toPandas())
    # the views of all texts are made once; training and scoring read them
    words = spark.sparkContext.broadcast(weights)
    rows = shared.write(rows.mapInArrow(gather(words), "doc_id long, held_out boolean, fold int, text array<double>, metadata array<double>"), "views")
    model = spark.sparkContext.broadcast(train(rows, known, chosen, sizes, shared) if chosen is not None else None)
    shared.keep("views")
    return rows.mapInArrow(scorer(model), SCHEMA)
